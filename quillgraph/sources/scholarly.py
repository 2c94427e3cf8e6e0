"""Answers of scholarly databases as rows of works: JSON and Atom bodies, parsed by explicit schemas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quillgraph.functions.identity import normal_arxiv, normal_doi

# Types of updates that withdraw a work.
RETRACTIONS = ("retraction", "withdrawal", "removal", "retracted")

@pandas_udf(T.StringType())
def _doi(values: pd.Series) -> pd.Series:
    return values.map(normal_doi)


@pandas_udf(T.StringType())
def _arxiv(values: pd.Series) -> pd.Series:
    return values.map(normal_arxiv)


def inverted_abstract(index: Column) -> Column:
    """The text of {word: [places]}; null for none."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))


def _work(**columns: Column) -> list[Column]:
    kinds = {"title": "string", "authors": "array<string>", "year": "int", "venue": "string", "doi": "string", "arxiv_id": "string", "abstract": "string", "citation_count": "bigint", "open_access_url": "string"}
    kinds |= {"retracted": "boolean", "retraction_doi": "string", "retraction_date": "string", "work_type": "string", "sources": "array<string>", "identifiers": "map<string,string>"}
    return [(columns[k] if k in columns else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]


def openalex(bodies: DataFrame) -> DataFrame:
    """query_id and works of bodies (query_id, body) of OpenAlex searches; what isn't JSON has none."""
    names = "results array<struct<display_name:string,title:string,publication_year:int,doi:string,cited_by_count:bigint,is_retracted:boolean,type:string,ids:map<string,string>,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>>,best_oa_location:struct<pdf_url:string,landing_page_url:string>>>"
    r = bodies.select("query_id", F.explode(F.from_json("body", names)["results"]).alias("r"))
    people = F.filter(F.transform("r.authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
    return r.select(
        "query_id",
        *_work(
            title=F.coalesce("r.display_name", "r.title", F.lit("")),
            authors=F.coalesce(people, F.array().cast("array<string>")),
            year=F.col("r.publication_year"),
            venue=F.col("r.primary_location.source.display_name"),
            doi=_doi("r.doi"),
            arxiv_id=_arxiv(F.col("r.ids")["arxiv"]),
            abstract=inverted_abstract(F.col("r.abstract_inverted_index")),
            citation_count=F.coalesce("r.cited_by_count", F.lit(0)),
            open_access_url=F.coalesce("r.best_oa_location.pdf_url", "r.best_oa_location.landing_page_url"),
            retracted=F.coalesce("r.is_retracted", F.lit(False)),
            work_type=F.col("r.type"),
            sources=F.array(F.lit("openalex")),
            identifiers=F.map_filter("r.ids", lambda k, v: v.isNotNull()),
        ),
    )


def crossref(bodies: DataFrame) -> DataFrame:
    """query_id and works of bodies of Crossref searches."""
    date = "struct<`date-parts`:array<array<int>>>"
    names = f"message struct<items:array<struct<title:array<string>,author:array<struct<family:string,given:string,name:string>>,issued:{date},published:{date},`published-print`:{date},`published-online`:{date},created:{date},`container-title`:array<string>,DOI:string,abstract:string,`is-referenced-by-count`:bigint,type:string,`updated-by`:array<struct<type:string,DOI:string,updated:{date}>>>>>"
    r = bodies.select("query_id", F.explode(F.from_json("body", names)["message"]["items"]).alias("r"))
    person = F.transform("r.author", lambda a: F.when(a["family"].isNotNull() & a["given"].isNotNull(), F.concat_ws(", ", a["family"], a["given"])).otherwise(F.coalesce(a["family"], a["name"])))
    dates = [F.try_element_at(F.try_element_at(F.col(f"r.`{k}`")["date-parts"], F.lit(1)), F.lit(1)) for k in ("issued", "published", "published-print", "published-online", "created")]
    notice = F.try_element_at(F.filter("r.updated-by", lambda u: F.lower(u["type"]).isin(*RETRACTIONS)), F.lit(1))
    title = F.coalesce(F.try_element_at("r.title", F.lit(1)), F.lit(""))
    stamp = F.array_join(F.try_element_at(notice["updated"]["date-parts"], F.lit(1)).cast("array<string>"), "-")
    return r.select(
        "query_id",
        *_work(
            title=title,
            authors=F.coalesce(F.filter(person, lambda n: n.isNotNull()), F.array().cast("array<string>")),
            year=F.coalesce(*dates),
            venue=F.try_element_at("r.container-title", F.lit(1)),
            doi=_doi("r.DOI"),
            abstract=F.trim(F.regexp_replace("r.abstract", "<[^>]+>", "")),
            citation_count=F.coalesce("r.is-referenced-by-count", F.lit(0)),
            retracted=F.coalesce(notice.isNotNull(), F.lit(False)) | F.upper(title).rlike("^(RETRACTED|WITHDRAWN)"),
            retraction_doi=_doi(notice["DOI"]),
            retraction_date=stamp,
            work_type=F.col("r.type"),
            sources=F.array(F.lit("crossref")),
            identifiers=F.when(F.col("r.DOI").isNotNull(), F.create_map(F.lit("doi"), "r.DOI")),
        ),
    )


def semantic_scholar(bodies: DataFrame) -> DataFrame:
    """query_id and works of bodies of Semantic Scholar searches."""
    names = "data array<struct<title:string,authors:array<struct<name:string>>,year:int,venue:string,abstract:string,citationCount:bigint,externalIds:map<string,string>,openAccessPdf:struct<url:string>,publicationTypes:array<string>>>"
    r = bodies.select("query_id", F.explode(F.from_json("body", names)["data"]).alias("r"))
    people = F.filter(F.transform("r.authors", lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    return r.select(
        "query_id",
        *_work(
            title=F.coalesce("r.title", F.lit("")),
            authors=F.coalesce(people, F.array().cast("array<string>")),
            year=F.col("r.year"),
            venue=F.when(F.col("r.venue") != "", F.col("r.venue")),
            doi=_doi(F.col("r.externalIds")["DOI"]),
            arxiv_id=_arxiv(F.col("r.externalIds")["ArXiv"]),
            abstract=F.col("r.abstract"),
            citation_count=F.coalesce("r.citationCount", F.lit(0)),
            open_access_url=F.col("r.openAccessPdf.url"),
            retracted=F.lit(False),
            work_type=F.lower(F.try_element_at("r.publicationTypes", F.lit(1))),
            sources=F.array(F.lit("semantic_scholar")),
            identifiers=F.map_filter("r.externalIds", lambda k, v: v.isNotNull()),
        ),
    )


_S = T.StringType()
_ENTRY = T.StructType([T.StructField("title", _S), T.StructField("authors", T.ArrayType(_S)), T.StructField("year", T.IntegerType()), *[T.StructField(k, _S) for k in ("doi", "arxiv_id", "abstract", "url", "identifier")]])


@pandas_udf(T.ArrayType(_ENTRY))
def _feed(bodies: pd.Series) -> pd.Series:
    import xml.etree.ElementTree as tree

    atom, arxiv = "{http://www.w3.org/2005/Atom}", "{http://arxiv.org/schemas/atom}"

    def said(node) -> str:
        return " ".join(node.text.split()) if node is not None and node.text else ""

    def parse(xml: str | None) -> list[dict]:
        try:
            root = tree.fromstring(xml or "")
        except tree.ParseError:
            return []
        out = []
        for e in root.iter(f"{atom}entry"):
            when, name = said(e.find(f"{atom}published"))[:4], said(e.find(f"{atom}id"))
            pdf = [link.get("href") for link in e.iter(f"{atom}link") if link.get("title") == "pdf"]
            out.append(
                {
                    "title": said(e.find(f"{atom}title")),
                    "authors": [said(a.find(f"{atom}name")) for a in e.iter(f"{atom}author")],
                    "year": int(when) if when.isdigit() else None,
                    "doi": normal_doi(said(e.find(f"{arxiv}doi"))),
                    "arxiv_id": normal_arxiv(name),
                    "abstract": said(e.find(f"{atom}summary")) or None,
                    "url": pdf[-1] if pdf else None,
                    "identifier": name or None,
                }
            )
        return out

    return bodies.map(parse)


def arxiv(bodies: DataFrame) -> DataFrame:
    """query_id and works of Atom bodies of arXiv; a malformed feed has none."""
    r = bodies.select("query_id", F.explode(_feed("body")).alias("r"))
    return r.select(
        "query_id",
        *_work(
            title=F.col("r.title"),
            authors=F.col("r.authors"),
            year=F.col("r.year"),
            venue=F.lit("arXiv"),
            doi=F.col("r.doi"),
            arxiv_id=F.col("r.arxiv_id"),
            abstract=F.col("r.abstract"),
            citation_count=F.lit(0),
            open_access_url=F.col("r.url"),
            retracted=F.lit(False),
            work_type=F.lit("preprint"),
            sources=F.array(F.lit("arxiv")),
            identifiers=F.when(F.col("r.identifier").isNotNull(), F.create_map(F.lit("arxiv"), "r.identifier")),
        ),
    )


READERS = {"openalex": openalex, "crossref": crossref, "semantic_scholar": semantic_scholar, "arxiv": arxiv}
