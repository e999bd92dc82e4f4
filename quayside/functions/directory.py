"""Users and roles named in directory entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def member_user(dn: Column) -> Column:
    """User of a member entry: the first component without its `cn=`."""
    return F.trim(F.replace(F.get(F.split(dn, ","), 0), F.lit("cn="), F.lit("")))


def header_roles(member_of: Column) -> Column:
    """Every role named by `cn=` in a group header, in order."""
    return F.regexp_extract_all(member_of, F.lit(r"cn=(.+?)(,|$)"), F.lit(1))
