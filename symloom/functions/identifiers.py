"""Column functions on identifiers, paths and markup; plain expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_identifier(c: Column) -> Column:
    """Words of an identifier in lower case: parted at other signs, case changes, acronym tails and digits."""
    c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")
    c = F.regexp_replace(c, r"([^\p{Lu} ])(\p{Lu})", "$1 $2")
    c = F.regexp_replace(c, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    c = F.regexp_replace(c, r"(\p{N})([^\p{N} ])", "$1 $2")
    c = F.regexp_replace(c, r"([^\p{N} ])(\p{N})", "$1 $2")
    return F.lower(F.trim(c))


SPLIT_SQL = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '([^\\p{{Lu}} ])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '(\\p{{N}})([^\\p{{N}} ])', '\\1 \\2', 'g'), '([^\\p{{N}} ])(\\p{{N}})', '\\1 \\2', 'g')))"


def safe_id(c: Column) -> Column:
    """A public id with runs of unsafe signs as one underscore and without trailing dots and hashes."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}._/:@+,=~#-]+", "_"), r"[.#]+$", "")


def verbatim(sig: Column, doc: Column) -> Column:
    """Searchable text of markup: delimiters become spaces, then entities are undone, the ampersand last."""
    t = F.translate(sig, '<>="/', "     ")
    for entity, sign in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when((doc != "") & (t != ""), F.concat(t, F.lit(" "), doc)).when(doc != "", doc).otherwise(t)


def slug(c: Column) -> Column:
    """A heading's anchor: lower case, other signs than letters, digits, blanks, hyphens and underscores dropped, blanks to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def join_path(base: Column, target: Column) -> Column:
    """``target`` seen from directory ``base``, with . and .. resolved; steps above the top stay. A leading slash means the top."""
    whole = F.when(target.startswith("/"), F.regexp_replace(target, "^/", "")).when(base == "", target).otherwise(F.concat(base, F.lit("/"), target))

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(part == ".", done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
