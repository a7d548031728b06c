"""Landed responses of metadata services as typed columns.

Each function takes rows of (key, JSON text of one work or organisation) and gives
one row for each, parsed by ``from_json`` with a fixed schema: what a record lacks
is null, fields of no use stay unread, and text that isn't JSON gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of each service's answers that are read.
CROSSREF = (
    "title array<string>, author array<struct<given:string,family:string,name:string,ORCID:string,sequence:string,affiliation:array<struct<name:string>>>>, abstract string, "
    "`container-title` array<string>, published struct<`date-parts`:array<array<int>>>, `is-referenced-by-count` bigint, `references-count` bigint, "
    "license array<struct<URL:string,start:struct<`date-time`:string>,`delay-in-days`:int>>, funder array<struct<name:string,DOI:string,award:array<string>>>, "
    "type string, ISSN array<string>, volume string, issue string, page string, publisher string, DOI string"
)
OPENALEX = (
    "id string, title string, publication_year int, publication_date string, type string, cited_by_count bigint, open_access struct<is_oa:boolean,oa_status:string,oa_url:string>, "
    "authorships array<struct<author_position:string,author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<id:string,display_name:string,country_code:string,type:string,ror:string>>>>, "
    "topics array<struct<id:string,display_name:string,score:double>>, primary_location struct<source:struct<id:string,display_name:string,issn:array<string>,type:string,is_oa:boolean>>, "
    "biblio struct<volume:string,issue:string,first_page:string,last_page:string>, doi string, ids map<string,string>, abstract_inverted_index map<string,array<int>>, referenced_works_count bigint, related_works array<string>"
)
LOCATION = "struct<url:string,url_for_pdf:string,url_for_landing_page:string,version:string,license:string,host_type:string,evidence:string>"
UNPAYWALL = (
    f"is_oa boolean, oa_status string, best_oa_location {LOCATION}, oa_locations array<{LOCATION}>, oa_locations_embargoed array<{LOCATION}>, first_oa_date string, "
    "journal_is_oa boolean, journal_is_in_doaj boolean, publisher string, year int"
)
SEMANTIC = (
    "paperId string, title string, abstract string, venue string, year int, citationCount bigint, influentialCitationCount bigint, referenceCount bigint, fieldsOfStudy array<string>, "
    "journal struct<name:string,volume:string,pages:string>, externalIds map<string,string>"
)
ROR = (
    "id string, status string, types array<string>, established int, names array<struct<value:string,types:array<string>,lang:string>>, "
    "locations array<struct<geonames_id:bigint,geonames_details:struct<name:string,country_name:string,country_code:string,lat:double,lng:double>>>, links array<struct<type:string,value:string>>, "
    "external_ids array<struct<type:string,preferred:string,`all`:array<string>>>, relationships array<struct<type:string,label:string,id:string>>, domains array<string>"
)
PERSON = "struct<name:string,givenName:string,familyName:string,nameType:string,contributorType:string,affiliation:array<string>,nameIdentifiers:array<struct<nameIdentifier:string,nameIdentifierScheme:string>>>"
DATACITE = (
    "id string, attributes struct<prefix:string,suffix:string,identifiers:array<struct<identifier:string,identifierType:string>>,"
    "alternateIdentifiers:array<struct<alternateIdentifier:string,alternateIdentifierType:string>>,titles:array<struct<title:string>>,"
    f"creators:array<{PERSON}>,contributors:array<{PERSON}>,publisher:string,container:map<string,string>,publicationYear:int,subjects:array<struct<subject:string,subjectScheme:string>>,"
    "dates:array<struct<date:string,dateType:string>>,language:string,types:struct<resourceType:string,resourceTypeGeneral:string>,sizes:array<string>,formats:array<string>,version:string,"
    "rightsList:array<struct<rights:string,rightsUri:string,rightsIdentifier:string>>,descriptions:array<struct<description:string,descriptionType:string>>,"
    "geoLocations:array<struct<geoLocationPlace:string>>,fundingReferences:array<struct<funderName:string,funderIdentifier:string,awardNumber:string>>,"
    "relatedIdentifiers:array<struct<relatedIdentifier:string,relatedIdentifierType:string,relationType:string>>,viewCount:bigint,downloadCount:bigint,referenceCount:bigint,"
    "citationCount:bigint,partCount:bigint,partOfCount:bigint,versionCount:bigint,versionOfCount:bigint,created:string,registered:string,published:string,updated:string,state:string,isActive:boolean,"
    "reason:string,url:string,contentUrl:array<string>,metadataVersion:int,schemaVersion:string,source:string,xml:string>, relationships map<string,struct<data:string>>"
)
ORCID = "https://orcid.org/"


def parsed(landed: DataFrame, key: str, json: str, schema: str) -> DataFrame:
    return landed.select(F.col(key), F.from_json(F.col(json), schema).alias("r"))


def filled(c: Column | str) -> Column:
    """An array or map; null where it is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.size(c) > 0, c)


def first(c: Column | str) -> Column:
    return F.get(F.col(c) if isinstance(c, str) else c, F.lit(0))


def count(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("long"))


def renamed(c: Column, fields: dict[str, str]) -> Column:
    """A struct's fields under other names; null where it is null."""
    return F.when(c.isNotNull(), F.struct(*(c[old].alias(new) for new, old in fields.items())))


def partial_date(parts: Column) -> Column:
    """Year, month and day, as many as there are, months and days with two digits."""
    return F.nullif(F.array_join(F.transform(F.slice(parts, 1, 3), lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))), "-"), F.lit(""))


def crossref(landed: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """Works of the DOI registry: ``key``, title, authors, abstract, journal, dates, counts, licence, funders, bibliography."""

    def author(a: Column) -> Column:
        given, family = (F.coalesce(a[x], F.lit("")) for x in ("given", "family"))
        name = F.coalesce(F.nullif(a["name"], F.lit("")), F.trim(F.concat_ws(" ", given, family)))
        orcid = F.when(F.startswith(a["ORCID"], F.lit(ORCID)), a["ORCID"]).otherwise(F.concat(F.lit(ORCID), F.nullif(a["ORCID"], F.lit(""))))
        places = F.filter(F.transform(a["affiliation"], lambda x: x["name"]), lambda x: x != "")
        return F.struct(name.alias("name"), given.alias("given"), family.alias("family"), orcid.alias("orcid"), F.coalesce(places, F.array().cast("array<string>")).alias("affiliation"), a["sequence"].alias("sequence"))

    license = first("r.license")
    return parsed(landed, key, json, CROSSREF).select(
        key, first("r.title").alias("title"), F.transform("r.author", author).alias("authors"), "r.abstract", first(F.col("r")["container-title"]).alias("journal"),
        partial_date(first(F.col("r")["published"]["date-parts"])).alias("publication_date"), count("r.`is-referenced-by-count`").alias("citation_count"), count("r.`references-count`").alias("references_count"),
        F.when(license.isNotNull(), F.struct(license["URL"].alias("url"), license["start"]["date-time"].alias("start"), license["delay-in-days"].alias("delay_in_days"))).alias("license"),
        filled(F.transform("r.funder", lambda f: renamed(f, {"name": "name", "doi": "DOI", "award": "award"}))).alias("funders"),
        "r.type", F.col("r.ISSN").alias("issn"), "r.volume", "r.issue", "r.page", "r.publisher", F.col("r.DOI").alias("doi"),
    )


def openalex(landed: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """Works of the open catalogue, with authors' institutions nested and the distinct ones of the work beside them."""

    def institution(i: Column) -> Column:
        return renamed(i, {"id": "id", "display_name": "display_name", "country": "country_code", "type": "type", "ror_id": "ror"})

    def author(a: Column) -> Column:
        who = a["author"]
        return F.struct(who["id"].alias("id"), who["display_name"].alias("display_name"), who["orcid"].alias("orcid"), filled(F.transform(a["institutions"], institution)).alias("institutions"), a["author_position"].alias("position"))

    access = F.col("r.open_access")
    return parsed(landed, key, json, OPENALEX).select(
        key, F.col("r.id").alias("openalex_id"), "r.title", "r.publication_year", "r.publication_date", "r.type", count("r.cited_by_count").alias("citation_count"),
        F.coalesce(access["is_oa"], F.lit(False)).alias("is_oa"), F.coalesce(access["oa_status"], F.lit("closed")).alias("oa_status"), access["oa_url"].alias("oa_url"),
        filled(F.transform("r.authorships", author)).alias("authors"), filled(F.array_distinct(F.flatten(F.transform("r.authorships", lambda a: F.transform(a["institutions"], institution))))).alias("institutions"),
        filled("r.topics").alias("topics"), F.col("r.primary_location.source").alias("venue"), "r.biblio", "r.doi", "r.ids", "r.abstract_inverted_index",
        count("r.referenced_works_count").alias("referenced_works_count"), "r.related_works",
    )


def unpaywall(landed: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """Open-access state, best place and all places of works."""
    short = {"url": "url", "version": "version", "license": "license"}
    some = {"url": "url", "url_for_pdf": "url_for_pdf", "version": "version", "license": "license", "repository_type": "host_type"}
    all_ = some | {"url_for_landing_page": "url_for_landing_page", "evidence": "evidence"}
    places = lambda c, fields: filled(F.transform(c, lambda x: renamed(x, fields)))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return parsed(landed, key, json, UNPAYWALL).select(
        key, flag("r.is_oa").alias("is_oa"), F.coalesce("r.oa_status", F.lit("closed")).alias("oa_status"), renamed(F.col("r.best_oa_location"), all_).alias("best_oa_location"),
        places("r.oa_locations", some).alias("oa_locations"), places("r.oa_locations_embargoed", short).alias("oa_locations_embargoed"), "r.first_oa_date",
        flag("r.journal_is_oa").alias("journal_is_oa"), flag("r.journal_is_in_doaj").alias("journal_is_in_doaj"), "r.publisher", "r.year",
    )


def semantic_scholar(landed: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """Papers of the citation graph: counts, fields of study and journal."""
    return parsed(landed, key, json, SEMANTIC).select(
        key, F.col("r.paperId").alias("semantic_scholar_id"), "r.title", "r.abstract", "r.venue", "r.year", F.col("r.citationCount").alias("citation_count"),
        F.col("r.influentialCitationCount").alias("influential_citation_count"), F.col("r.referenceCount").alias("reference_count"), F.col("r.fieldsOfStudy").alias("fields_of_study"),
        "r.journal", F.element_at("r.externalIds", "DOI").alias("doi"), F.element_at("r.externalIds", "PubMed").alias("pmid"),
    )


def ror(landed: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """Organisations: the display name, else the first label; the first place; the website; preferred ids of other registries."""
    named = lambda kind: first(F.filter("r.names", lambda n: F.array_contains(n["types"], kind)))["value"]
    preferred = lambda kind: F.try_element_at(F.filter(F.transform(F.filter("r.external_ids", lambda x: x["type"] == kind), lambda x: x["preferred"]), lambda x: x != ""), F.lit(-1))
    place = first("r.locations")["geonames_details"]
    own = {"fundref_id": "fundref", "grid_id": "grid", "isni": "isni", "wikidata_id": "wikidata"}
    return parsed(landed, key, json, ROR).select(
        key, F.col("r.id").alias("ror_id"), "r.status", "r.types", "r.established", "r.names", F.coalesce(named("ror_display"), named("label")).alias("display_name"),
        place["country_name"].alias("country"), place["country_code"].alias("country_code"), place["name"].alias("city"), place["lat"].alias("latitude"), place["lng"].alias("longitude"),
        first(F.filter("r.links", lambda x: x["type"] == "website"))["value"].alias("website"), *(preferred(kind).alias(name) for name, kind in own.items()),
        "r.relationships", "r.domains",
    )


def datacite(landed: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """Data sets and other registered works: the attributes by their own names in snake case, the first title, counts from 0."""
    a = lambda name: F.col("r.attributes")[name]
    plain = {
        "prefix": "prefix", "suffix": "suffix", "identifiers": "identifiers", "alternate_identifiers": "alternateIdentifiers", "creators": "creators", "contributors": "contributors", "publisher": "publisher",
        "container": "container", "publication_year": "publicationYear", "subjects": "subjects", "dates": "dates", "language": "language", "sizes": "sizes", "formats": "formats", "version": "version",
        "rights_list": "rightsList", "descriptions": "descriptions", "geo_locations": "geoLocations", "funding_references": "fundingReferences", "related_identifiers": "relatedIdentifiers",
        "created": "created", "registered": "registered", "published": "published", "updated": "updated", "state": "state", "is_active": "isActive", "reason": "reason", "url": "url", "content_url": "contentUrl",
        "metadata_version": "metadataVersion", "schema_version": "schemaVersion", "source_system": "source", "xml": "xml",
    }
    counts = {"view_count": "viewCount", "download_count": "downloadCount", "reference_count": "referenceCount", "citation_count": "citationCount", "part_count": "partCount", "part_of_count": "partOfCount", "version_count": "versionCount", "version_of_count": "versionOfCount"}
    return parsed(landed, key, json, DATACITE).select(
        key, F.col("r.id").alias("doi"), first(a("titles"))["title"].alias("title"), a("types")["resourceType"].alias("resource_type"), a("types")["resourceTypeGeneral"].alias("resource_type_general"),
        *(a(old).alias(new) for new, old in plain.items()), *(F.coalesce(a(old), F.lit(0).cast("long")).alias(new) for new, old in counts.items()), "r.relationships",
    )
