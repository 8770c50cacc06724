"""Column expressions over names, paths, labels and markup."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stem(name: Column | str) -> Column:
    """A file name without its last suffix; a name of a suffix alone stays."""
    return F.regexp_replace(_c(name), r"(?<=.)\.[^.]+$", "")


def suffix(name: Column | str) -> Column:
    """The last suffix in lower case, with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(_c(name), r".(\.[^.]+)$", 1))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def slug_label(name: Column | str) -> Column:
    """A readable label: the stem, with runs of _ and - and of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(stem(name), "[_-]+", " "), r"(?U)\s+", " "))


def icon_id(path: Column | str) -> Column:
    return F.substring(F.sha1(_c(path).cast("binary")), 1, 16)


def normalized_path(path: Column | str, set_id: Column | str) -> Column:
    """Where the normalised raster of a path lies."""
    return normalized_name(slug_label(base_name(path)), F.sha1(_c(path).cast("binary")), set_id)


def normalized_name(slug: Column, sha: Column, set_id: Column | str) -> Column:
    """Its slug, at most 80 characters, and 12 digits of its hash."""
    short = F.substring(F.replace(F.lower(slug), F.lit(" "), F.lit("_")), 1, 80)
    return F.concat(F.lit("icon_data/normalized_256/"), _c(set_id), F.lit("/"), or_else(short, F.lit("icon")), F.lit("__"), F.substring(sha, 1, 12), F.lit(".png"))


def or_else(value: Column, other: Column) -> Column:
    """The value unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), other)


def short_label(value: Column | str, most: int) -> Column:
    v = _c(value)
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.substring(v, 1, most - 1), F.lit("...")))


def _words(value: Column, change, glue: str) -> Column:
    return F.array_join(F.transform(F.split(value, "-"), change), glue)


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))


def component_name(value: Column | str) -> Column:
    """kebab-case as PascalCase with Icon behind it, and before it where the name begins with a digit."""
    name = F.concat(_words(_c(value), _capital, ""), F.lit("Icon"))
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("Icon"), name)).otherwise(name)


def variable_name(value: Column | str) -> Column:
    name = _words(_c(value), _capital, "")
    return F.concat(F.lower(F.substring(name, 1, 1)), name.substr(F.lit(2), F.length(name)))


def constant_name(value: Column | str) -> Column:
    return F.upper(F.replace(_c(value), F.lit("-"), F.lit("_")))


def title_name(value: Column | str) -> Column:
    return _words(_c(value), _capital, " ")


def url_slug(value: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(value)), " ", "-")


def url_path(value: Column | str) -> Column:
    """Percent-encoding with %20 for spaces."""
    return F.replace(F.url_encode(_c(value)), F.lit("+"), F.lit("%20"))


def safe_name(title: Column | str) -> Column:
    return F.replace(F.regexp_replace(_c(title), "^File:", ""), F.lit("/"), F.lit("_"))


def plain_text(value: Column | str) -> Column:
    """Keeps letters, digits and a few marks; collapses the rest to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(value), "[^A-Za-z0-9 /&().'-]+", " "), r"\s+", " "))


def first_categories(categories: Column | str, tags: Column | str, most: int = 3) -> Column:
    """Up to three categories, or tags where there are none."""
    c = _c(categories)
    return F.array_join(F.slice(F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c).otherwise(F.coalesce(_c(tags), F.array().cast("array<string>"))), 1, most), "; ")


def joined_parts(*parts: Column | str, glue: str = " / ") -> Column:
    return F.array_join(F.filter(F.array(*(F.coalesce(_c(p), F.lit("")) for p in parts)), lambda x: x != ""), glue)


def notes(**pairs: Column | str) -> Column:
    return F.concat_ws("; ", *(F.concat(F.lit(f"{k}="), F.coalesce(_c(v).cast("string"), F.lit(""))) for k, v in pairs.items()))


def clean_svg(markup: Column | str) -> Column:
    """The inside of an svg element: declarations, comments and the outer tags go, white space collapses."""
    x = F.regexp_replace(_c(markup), r"<\?xml[^>]*>|<!DOCTYPE[^>]*>", "")
    x = F.regexp_replace(x, r"<!--[^>]*-->", "")
    x = F.regexp_replace(x, r"</?svg[^>]*>", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def view_box(markup: Column | str, default: str = "0 0 200 200") -> Column:
    return or_else(F.regexp_extract(_c(markup), r'viewBox="([^"]+)"', 1), F.lit(default))


def code_point(hexcode: Column | str) -> Column:
    return F.conv(_c(hexcode), 16, 10).cast("long")


def hex_of(number: Column | str) -> Column:
    return F.hex(_c(number))


@F.pandas_udf(StringType())
def characters(hexcodes: pd.Series) -> pd.Series:
    """The text of code points written in hexadecimal and joined by -; char() knows the first 256 only. A number that no character has (a surrogate's, or one above 10FFFF)
    is the replacement character."""

    def one(n: int) -> str:
        return "\ufffd" if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)

    return hexcodes.map(lambda h: "".join(one(int(x, 16)) for x in h.split("-")) if h else h)


@F.pandas_udf(StringType())
def hexcodes(texts: pd.Series) -> pd.Series:
    """The code points of a text as `characters` reads them."""
    return texts.map(lambda t: "-".join(f"{ord(c):04X}" for c in t) if t else t)


def replaced_codes(hexcodes: Column | str) -> Column:
    """Code points as `characters` can write them: FFFD for a number that no character has."""
    return F.regexp_replace(_c(hexcodes), "(?<![^-])(?:D[89A-F][0-9A-F]{2}|1[1-9A-F][0-9A-F]{4}|[2-9A-F][0-9A-F]{5}|[1-9A-F][0-9A-F]{6,})(?![^-])", "FFFD")


@F.pandas_udf(StringType())
def symbol_file(ids: pd.Series) -> pd.Series:
    """File stem of a symbol id: the first of its comma-joined names, decomposed, as a slug of at most 80 characters; `symbol_name` adds the hash."""
    first = ids.fillna("").str.split(",").str[0].str.lower().map(lambda x: unicodedata.normalize("NFKD", x))
    slug = first.str.replace(r"[^A-Za-z0-9_\s-]", "", regex=True).str.replace(r"[_\s-]+", "_", regex=True).str.strip("_").str.slice(0, 80)
    return slug.where(slug != "", "symbol")


def symbol_name(ids: Column | str) -> Column:
    """The file stem of a symbol id, with the first 12 digits of the id's hash, so that equal slugs stay apart."""
    return F.concat(symbol_file(_c(ids)), F.lit("_"), F.substring(F.sha1(F.coalesce(_c(ids), F.lit("")).cast("binary")), 1, 12))


def fill_template(template: Column | str, values: Column | str) -> Column:
    """Puts map values in place of {key}; unknown keys stay."""

    @F.pandas_udf(StringType())
    def fill(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import re

        for t, v in batches:
            yield pd.Series([None if x is None else re.sub(r"\{(\w+)\}", lambda m: dict(y or {}).get(m[1], m[0]), x) for x, y in zip(t, v, strict=True)], dtype="object")  # noqa: B023

    return fill(_c(template), _c(values))


escape = html.escape


def html_escaped(value: Column | str) -> Column:
    x = _c(value)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(mark), F.lit(name))
    return x
