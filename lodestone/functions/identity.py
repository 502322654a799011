"""Stable identities as column expressions: name-based UUIDs, document and passage ids, hashes, identifiers in text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

DNS, URL = uuid.NAMESPACE_DNS, uuid.NAMESPACE_URL


def uuid5(name: Column, namespace: uuid.UUID = DNS) -> Column:
    """The version 5 UUID of the UTF-8 name in the namespace, as lower-case text; null for a null name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    # the variant digit keeps the low two bits of the hash's 17th digit
    low = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 1
    variant = F.lit("89ab").substr(low, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def normal_title(title: Column) -> Column:
    """Lower case, without what is neither word character nor space (Unicode), single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def title_hash(title: Column) -> Column:
    return F.substring(F.sha2(normal_title(title), 256), 1, 16)


def _given(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def doc_key(doi: Column, pmid: Column, arxiv: Column, title: Column, year: Column, first_author: Column) -> Column:
    """The name that a document's id is made of: DOI, else PMID, else arXiv number without version, else title, year
    and first author."""
    author = F.coalesce(_given(F.lower(first_author)), F.lit("unknown"))
    rest = F.concat(F.lit("th:"), F.coalesce(title_hash(title), F.lit("")), F.lit("|y:"), F.coalesce(year.cast("string"), F.lit("")), F.lit("|a:"), author)
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(_given(doi))), F.concat(F.lit("pmid:"), _given(pmid)), F.concat(F.lit("arxiv:"), F.substring_index(_given(arxiv), "v", 1)), rest)


def doc_id(*parts: Column) -> Column:
    return uuid5(doc_key(*parts))


def passage_id(doc: Column, page: Column, start: Column, end: Column) -> Column:
    return uuid5(F.concat(doc, F.lit("|p:"), page.cast("string"), F.lit("|s:"), start.cast("string"), F.lit("|e:"), end.cast("string")))


def code_chunk_uuid(repo: Column, path: Column, name: Column, line: Column) -> Column:
    return uuid5(F.concat_ws(":", repo, path, name, line.cast("string")), URL)


def short_hash(value: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def paper_key(title: Column) -> Column:
    return F.md5(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""))


def doi_in(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(10\.[0-9]{4,9}/[^\s\"'<>]+)", 1), r"[).,;]+$", ""), F.lit(""))


def pmid_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)pmid:?\s*([0-9]{4,9})", 1), F.lit(""))


def arxiv_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)arxiv:?\s*([0-9]{4}\.[0-9]{4,5})", 1), F.lit(""))


def year_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(19[0-9]{2}|20[0-9]{2})\b", 1), F.lit("")).cast("int")


def repos_in(text: Column) -> Column:
    """The distinct owner/name pairs of repository links, in order of first mention."""
    found = F.regexp_extract_all(text, F.lit(r"github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda r: F.regexp_replace(r, r"(\.git|[.])$", "")))


def hash_shard(key: Column, shards: int) -> Column:
    """The shard, from 0, of a hexadecimal key by its first eight digits; never negative."""
    return F.pmod(F.conv(F.substring(F.regexp_replace(key, "-", ""), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")
