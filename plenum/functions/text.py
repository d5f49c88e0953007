"""Column functions over names, URIs, dates, colours and pages' texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The colours of subjects without one of their own.
COLOURS = ["4472C4", "ED7D31", "A9D18E", "FF5252", "00BCD4", "7B1FA2", "388E3C", "FFC107", "E91E63", "009688", "795548", "607D8B", "FF6F00", "283593", "1B5E20"]

#: Three-letter to two-letter country codes.
COUNTRIES = {"AUT": "AT", "BEL": "BE", "BGR": "BG", "CYP": "CY", "CZE": "CZ", "DEU": "DE", "DNK": "DK", "EST": "EE", "GRC": "EL", "ESP": "ES", "FIN": "FI", "FRA": "FR", "HRV": "HR", "HUN": "HU", "IRL": "IE", "ITA": "IT", "LTU": "LT", "LUX": "LU", "LVA": "LV", "MLT": "MT", "NLD": "NL", "POL": "PL", "PRT": "PT", "ROU": "RO", "SWE": "SE", "SVN": "SI", "SVK": "SK"}


def basename(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def basenames(uris: Column) -> Column:
    return F.transform(uris, basename)


def is_female(uri: Column) -> Column:
    return basename(uri) == "FEMALE"


def term_number(uri: Column) -> Column:
    return F.substring(basename(uri), 4, 1000).try_cast("int")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "").try_cast("int")


def timestamp(s: Column) -> Column:
    """ISO date or time, maybe at the end of a URI, as `YYYY-MM-DD HH:MM:SS`; a date alone is midnight; shorter: null."""
    last = basename(s)
    full = F.regexp_extract(last, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})", 0)
    return F.when(full != "", F.translate(full, "T", " ")).when(F.length(last) >= 10, F.concat(F.left(last, F.lit(10)), F.lit(" 00:00:00")))


def country_code(s: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv))
    return F.coalesce(F.element_at(known, s), s)


def colour(stored: Column, key: Column) -> Column:
    """#stored, else one of the fixed colours by the key's checksum, the same in every run."""
    return F.concat(F.lit("#"), F.coalesce(stored, F.element_at(F.array(*map(F.lit, COLOURS)), (F.pmod(F.crc32(key.cast("binary")), F.lit(len(COLOURS))) + 1).cast("int"))))


def web_colour(stored: Column) -> Column:
    """#stored, else the one grey."""
    return F.concat(F.lit("#"), F.coalesce(stored, F.lit("9E9E9E")))


def item_parts(item: Column) -> tuple[Column, Column]:
    """What stands before and behind the last colon of an item."""
    last = F.substring_index(item, ":", -1)
    return F.left(item, F.length(item) - F.length(last) - 1), last


def direction(share: Column) -> Column:
    return F.when(share > 0.65, "YES").when(share < 0.35, "NO").otherwise("ABSTAIN")


def token_estimate(s: Column) -> Column:
    return F.floor(F.length(s) / 4).cast("long")


def slug(url: Column) -> Column:
    return F.rtrim(F.regexp_extract(url, r"/wiki/(.*)$", 1), F.lit("/"))


def one_line(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def decomposed(s: Column) -> Column:
    """Compatibility decomposition; Spark has no function for it."""

    @F.pandas_udf("string")
    def nfkd(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))

    return nfkd(s)


def ascii_name(s: Column) -> Column:
    """Without what stands in parentheses, ASCII only, lower case, single blanks."""
    plain = F.regexp_replace(decomposed(F.regexp_replace(s, r"\([^)]*\)", "")), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def folded_name(s: Column) -> Column:
    """Without combining marks, lower case; other characters than a-z and digits part words."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(decomposed(s), r"\p{M}", "")), "[^a-z0-9]+", " "))


def normal_forms(names: Column, form: str = "ascii") -> Column:
    """Normal forms of an array of names, distinct, in order, without nulls and empty ones; one pass for all of a row.

    form ascii: as ascii_name, other characters than ASCII go; folded: as folded_name, they part words.
    """
    joined = F.lower(decomposed(F.array_join(names, "\u0001")))
    joined = F.regexp_replace(joined, r"[^\x00-\x7F]", "") if form == "ascii" else F.regexp_replace(joined, r"\p{M}", "")
    plain = F.transform(F.split(joined, "\u0001"), lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")))
    return F.coalesce(F.array_distinct(F.filter(plain, lambda x: x != "")), F.array().cast("array<string>"))


def aliases(name: Column, *more: Column, form: str = "ascii") -> Column:
    """Normal forms of the name without its parentheses, of what stands in each of them, and of `more`, also without.

    form folded, as registries compare: the whole name is one of them too, and `more` are taken whole.
    """
    bare = lambda c: F.regexp_replace(c, r"\([^)]*\)", "" if form == "ascii" else " ")
    outside, inner = bare(name), F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1))
    inner = F.coalesce(inner, F.array().cast("array<string>"))
    whole, more = ([F.array(name)], more) if form == "folded" else ([], tuple(map(bare, more)))
    return normal_forms(F.concat(*whole, F.array(outside), inner, F.array(*more) if more else F.array().cast("array<string>")), form)


def entity_id(html: Column) -> Column:
    """The Q number of the first JSON-LD script of a page whose main entity, or else whose sameAs, is a URL of wikidata.org.

    Scripts that are no JSON or no object are passed over, and so is a main entity or sameAs that
    is no text; an empty main entity counts as none. No such script, or no page: null.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?(?=[\s>])[^>]*>(.*?)</script"""), F.lit(1))

    def found(script: Column) -> Column:
        value = F.try_parse_json(script)
        main, same = (F.try_variant_get(value, f"$.{c}", "variant") for c in ("mainEntity", "sameAs"))
        kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        text = lambda v, path: F.when(kind(v) == "STRING", F.try_variant_get(value, path, "string"))
        said = F.try_variant_get(value, "$.mainEntity", "string")
        none = main.isNull() | (kind(main) == "VOID") | F.coalesce(said.isin("", "0", "false", "[]", "{}"), F.lit(False))
        url = F.when(none, text(same, "$.sameAs")).otherwise(text(main, "$.mainEntity"))
        return F.when(F.contains(url, F.lit("wikidata.org")), F.nullif(F.regexp_extract(url, "Q[0-9]+", 0), F.lit("")))

    return F.get(F.filter(F.transform(scripts, found), lambda x: x.isNotNull()), F.lit(0))
