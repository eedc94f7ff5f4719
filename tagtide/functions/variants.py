"""Surface forms under which a tag may be written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A version number that does not follow '-' or '.'; the character before it is not part of it.
_VERSION = r"[^-.](\p{Nd}+(\.\p{Nd}+)*)"
_MAJOR = r"^(\p{Nd}+)(\.0)*$"


def version_forms(tag: Column) -> Column:
    """The tag; the tag with '-' before its version; with the bare major version if that says the same."""
    version = F.regexp_extract(tag, _VERSION, 1)
    major = F.regexp_extract(version, _MAJOR, 1)
    dashed = F.when(version != "", F.replace(tag, version, F.concat(F.lit("-"), version)))
    bare = F.when(major != "", F.replace(tag, version, F.concat(F.lit("-"), major)))
    return F.array_distinct(F.array_compact(F.array(tag, dashed, bare)))


def spellings(forms: Column) -> Column:
    """Each form as it is, with spaces for hyphens, and without hyphens."""
    written = F.transform(
        forms,
        lambda form: F.array(
            form,
            F.replace(form, F.lit("-"), F.lit(" ")),
            F.replace(form, F.lit("-"), F.lit("")),
        ),
    )
    return F.array_distinct(F.flatten(written))


def tag_variants(tag: Column) -> Column:
    return spellings(version_forms(tag))
