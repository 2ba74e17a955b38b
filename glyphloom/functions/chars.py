"""Classes of characters, shapes, masks: native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = r"(\p{L}+|\p{Nd}+|[^\p{L}\p{Nd}]+)"
SHAPE_RUNS = r"(\p{Nd}+|\p{Ll}+|\p{Lu}+|[^\p{Nd}\p{Ll}\p{Lu}]+)"
# Characters that stand for letters, and the letters.
LEET_FROM, LEET_TO = "01345!@$9", "oieasiasg"


def runs(v: Column) -> Column:
    """Maximal runs of letters, digits and others."""
    return F.regexp_extract_all(v, F.lit(RUNS), F.lit(1))


def run_class(run: Column) -> Column:
    return F.when(run.rlike(r"^\p{L}"), "L").when(run.rlike(r"^\p{Nd}"), "D").otherwise("S")


def structure(v: Column) -> Column:
    """The classes of the runs with their lengths, as L4 D2 S1."""
    return F.array_join(F.transform(runs(v), lambda r: F.concat(run_class(r), F.length(r).cast("string"))), " ")


def shape(v: Column) -> Column:
    """Runs of digits, lower case, upper case and others with their lengths; EMPTY for none."""
    kind = lambda r: F.when(r.rlike(r"^\p{Nd}"), "D").when(r.rlike(r"^\p{Ll}"), "l").when(r.rlike(r"^\p{Lu}"), "U").otherwise("S")
    out = F.array_join(F.transform(F.regexp_extract_all(v, F.lit(SHAPE_RUNS), F.lit(1)), lambda r: F.concat(kind(r), F.length(r).cast("string"))), "")
    return F.when(out == "", "EMPTY").otherwise(out)


def pattern(v: Column) -> Column:
    """As a shape, with the other characters as they are."""
    one = lambda r: F.when(r.rlike(r"^\p{Nd}"), F.concat(F.lit("D"), F.length(r).cast("string"))).when(r.rlike(r"^\p{Ll}"), F.concat(F.lit("l"), F.length(r).cast("string"))).when(r.rlike(r"^\p{Lu}"), F.concat(F.lit("U"), F.length(r).cast("string"))).otherwise(r)
    return F.array_join(F.transform(F.regexp_extract_all(v, F.lit(SHAPE_RUNS), F.lit(1)), one), "")


def masked(v: Column, salt: str = "", digits: int = 10) -> Column:
    """Shape and a short hash. Without a salt a short value can be found by trying."""
    return F.concat(shape(v), F.lit("#sha256:"), F.substring(F.sha2(F.concat(F.lit(salt), v).cast("binary"), 256), 1, digits))


def leet(v: Column) -> Column:
    return F.translate(F.lower(v), LEET_FROM, LEET_TO)


# Short parts before or after a core.
AFFIX = r"^([0-9]{1,2}|(19|20)[0-9]{2}|[!@#$%^&*]|[!@#$%^&*][0-9]|[0-9][!@#$%^&*])$"
EMAIL = r"^[\p{L}\p{Nd}_.%+-]+@[\p{L}\p{Nd}_.-]+\.[\p{L}\p{Nd}_]+$"


def email_local(v: Column) -> Column:
    return F.substring_index(v, "@", 1)


def email_domain(v: Column) -> Column:
    """The main label of the domain: the third from the end of three or more, the first of two, else the whole."""
    host = F.regexp_replace(v, "^[^@]*@", "")
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) >= 3, F.try_element_at(labels, F.lit(-3))).when(F.size(labels) == 2, F.get(labels, F.lit(0))).otherwise(host)
