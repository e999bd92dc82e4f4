"""Permissions, roles and grants: the changes that bring one in line with another.

Nothing here runs a grant. Every operator compares whole tables and returns the
rows to grant or revoke, where a loop would ask for one privilege at a time.

Grants have `principal_type`, `principal`, `db_name`, `tbl_name`, `privilege`,
`grant_option`; catalog tables `db_id`, `db_name` and `tbl_id`, `db_id`, `tbl_name`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import directory, names
from quayside.operators.joins import attach_rows, join_salted
from quayside.session import stable

# The user that stands for everybody, and the role all users have.
EVERYBODY = "*"
PUBLIC_ROLE = "public"
SCHEMA_PRIVILEGES = ["SELECT", "INSERT", "UPDATE", "DELETE"]
GRANT = ["principal_type", "principal", "db_name", "tbl_name", "privilege"]


@dataclass(frozen=True)
class RoleNames:
    """Names of the roles and groups of one application, built from its short name."""

    application: str

    @property
    def prefix(self) -> str:
        return f"app_{self.application}_acl_"

    @property
    def everyone(self) -> str:
        """Role of databases that have no group of their own."""
        return f"{self.prefix}ro_public"

    @property
    def users_group(self) -> str:
        return f"app_{self.application}_users"


# Catalog -------------------------------------------------------------------


def objects_in(databases: DataFrame, tables: DataFrame, location_pattern: str) -> DataFrame:
    """Databases at a location with their tables; a database without any stays."""
    chosen = databases.where(
        (F.col("db_name") != "default") & F.col("db_location").rlike(location_pattern)
    )
    return attach_rows(chosen, tables, ["db_id"])


def tables_by_name(databases: DataFrame, tables: DataFrame) -> DataFrame:
    return tables.join(databases.select("db_id", "db_name"), "db_id").select("db_name", "tbl_name")


def role_members(roles: DataFrame, role_map: DataFrame) -> DataFrame:
    users = role_map.where(F.col("principal_type") == "USER")
    return users.join(roles, "role_id").select("role_name", F.col("principal_name").alias("user"))


def nested_roles(roles: DataFrame, role_map: DataFrame) -> DataFrame:
    """`role_name` with each role that is its member, directly or through others, as `member_role`.

    Each round follows only the pairs found last, so there are as many rounds as the
    longest chain has links; a cycle finds no new pairs and ends. A role in a cycle is
    among its own members.
    """
    nested = role_map.where(F.col("principal_type") == "ROLE").join(roles, "role_id")
    links = stable(nested.select("role_name", F.col("principal_name").alias("member_role")).distinct())
    links = links.join(roles.select(F.col("role_name").alias("member_role")).distinct(), "member_role", "left_semi")
    found = fresh = stable(links.select("role_name", "member_role"))
    pair = ["role_name", "member_role"]
    below = links.select(F.col("role_name").alias("member_role"), F.col("member_role").alias("deeper"))
    while not fresh.isEmpty():
        further = fresh.join(below, "member_role").select("role_name", F.col("deeper").alias("member_role")).distinct()
        fresh = stable(further.join(found, pair, "left_anti"))
        found = found.unionByName(fresh)
    return found


def all_role_members(roles: DataFrame, role_map: DataFrame) -> DataFrame:
    """Users of each role, its own and those of the roles nested in it."""
    own = role_members(roles, role_map)
    inner = own.withColumnRenamed("role_name", "member_role")
    inherited = nested_roles(roles, role_map).join(inner, "member_role").select("role_name", "user")
    return own.unionByName(inherited).distinct()


def table_privileges(databases: DataFrame, tables: DataFrame, grants: DataFrame) -> DataFrame:
    """Every table with its grants; a table without grants stays."""
    located = tables.join(databases.select("db_id", "db_name"), "db_id")
    return attach_rows(
        located.select("db_name", "tbl_name", "tbl_id"),
        grants.select("db_name", "tbl_name", "principal_type", "principal", "privilege"),
        ["db_name", "tbl_name"],
    )


def missing(wanted: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Wanted rows that do not exist: one anti join for any number of checks."""
    return wanted.join(existing.select(*on), on, "left_anti")


def present(wanted: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    return wanted.join(existing.select(*on), on, "left_semi")


def misplaced_databases(databases: DataFrame, users: DataFrame, root: str) -> DataFrame:
    """User databases recorded at a location other than the expected one."""
    expected = users.select(
        names.user_schema(F.col("user"), fold_case=False).alias("db_name"),
        names.user_schema_location(root, F.col("user"), fold_case=False).alias("expected"),
    )
    return databases.join(expected, "db_name").where(F.col("expected") != F.col("db_location")).select(
        "db_name", F.col("db_location").alias("recorded"), "expected"
    )


# Namespace permissions -----------------------------------------------------


def readers(permissions: DataFrame) -> DataFrame:
    """Users with READ per namespace, one row each."""
    return (
        permissions.where(F.array_contains("permissions", "READ"))
        .select("namespace", "user_id")
        .distinct()
    )


def public_namespaces(permissions: DataFrame) -> DataFrame:
    """Each namespace with whether everybody may read it."""
    reads_all = F.array_contains("permissions", "READ") & (F.col("user_id") == EVERYBODY)
    return permissions.groupBy("namespace").agg(F.bool_or(reads_all).alias("is_public"))


def _select_of(principal_type: str, principal: Column) -> list[Column]:
    return [
        F.lit(principal_type).alias("principal_type"),
        principal.alias("principal"),
        F.col("db_name"),
        F.col("tbl_name"),
        F.lit("SELECT").alias("privilege"),
    ]


def _namespace_readers(permissions: DataFrame) -> DataFrame:
    return readers(permissions).where(F.col("user_id") != EVERYBODY).select(
        F.lower("namespace").alias("db_name"), "user_id"
    ).distinct()


def wanted_reads(permissions: DataFrame, table_names: DataFrame) -> DataFrame:
    """SELECT on every table of the namespaces a user may read.

    A namespace may have most of the users and most of the tables, so its users
    are spread over tasks that each see its tables.
    """
    pairs = join_salted(_namespace_readers(permissions), table_names, ["db_name"])
    return pairs.select(*_select_of("USER", F.col("user_id")))


def _lacking(users: DataFrame, tables: DataFrame, held: DataFrame) -> DataFrame:
    """Users and databases of which the user holds fewer tables than there are."""
    sizes = tables.groupBy("db_name").agg(F.count(F.lit(1)).alias("_tables"))
    counted = (
        held.select("db_name", "tbl_name", F.col("principal").alias("user_id")).distinct()
        .join(tables, ["db_name", "tbl_name"], "left_semi")
        .groupBy("db_name", "user_id").agg(F.count(F.lit(1)).alias("_held"))
    )
    met = users.join(sizes, "db_name").join(counted, ["db_name", "user_id"], "left")
    return met.where(F.coalesce("_held", F.lit(0)) < F.col("_tables")).select("db_name", "user_id")


def full_sync(
    permissions: DataFrame, table_names: DataFrame, grants: DataFrame, full_revoke: bool = False
) -> DataFrame:
    """Grants the permissions call for; with `full_revoke` also those to take back.

    Users and tables are counted before they are paired: only a user who lacks
    some table of a database is spelled out over its tables.
    """
    users, tables = _namespace_readers(permissions), table_names.select("db_name", "tbl_name").distinct()
    held = grants.where(
        (F.col("principal_type") == "USER") & (F.col("privilege") == "SELECT")
    ).select(*GRANT)
    lacking = stable(_lacking(users, tables, held))
    wanted = join_salted(lacking, tables, ["db_name"]).select(*_select_of("USER", F.col("user_id")))
    to_grant = missing(wanted, grants, GRANT).withColumn("action", F.lit("grant"))
    if not full_revoke:
        return to_grant
    known = permissions.select(F.lower("namespace").alias("db_name")).distinct()
    held = held.join(known, "db_name", "left_semi").select(*GRANT)
    rightful = held.join(tables, ["db_name", "tbl_name"], "left_semi").join(
        users.select("db_name", F.col("user_id").alias("principal")), ["db_name", "principal"], "left_semi"
    )
    return to_grant.unionByName(missing(held, rightful, GRANT).withColumn("action", F.lit("revoke")))


def public_sync(permissions: DataFrame, table_names: DataFrame, grants: DataFrame) -> DataFrame:
    """SELECT of the public role to grant or revoke, per table of a known namespace."""
    flags = public_namespaces(permissions).groupBy(F.lower("namespace").alias("db_name")).agg(
        F.bool_or("is_public").alias("is_public")
    )
    of_public = grants.where(
        (F.col("principal_type") == "ROLE")
        & (F.col("principal") == PUBLIC_ROLE)
        & (F.col("privilege") == "SELECT")
    ).select("db_name", "tbl_name", F.lit(True).alias("_has")).distinct()
    judged = table_names.join(flags, "db_name").join(of_public, ["db_name", "tbl_name"], "left")
    has = F.coalesce("_has", F.lit(False))
    return judged.where(F.col("is_public") != has).select(
        *_select_of("ROLE", F.lit(PUBLIC_ROLE)),
        F.when(F.col("is_public"), "grant").otherwise("revoke").alias("action"),
    )


def delta_sync(
    changes: DataFrame, permissions: DataFrame, table_names: DataFrame, grants: DataFrame
) -> DataFrame:
    """Grants and revokes for changed (namespace, user) pairs.

    A pair that still has READ is granted what it lacks, any other loses what it
    has. A change for everybody brings a full sync and the public role with it.
    A namespace without tables gives no rows.
    """
    pairs = changes.select("namespace", "user_id").distinct()
    asked = pairs.where(F.col("user_id") != EVERYBODY)
    granting = present(asked, readers(permissions), ["namespace", "user_id"])
    losing = missing(asked, readers(permissions), ["namespace", "user_id"])

    def on_tables(users: DataFrame) -> DataFrame:
        named = users.select(F.lower("namespace").alias("db_name"), "user_id").distinct()
        return join_salted(named, table_names, ["db_name"]).select(
            *_select_of("USER", F.col("user_id"))
        )

    grant = missing(on_tables(granting), grants, GRANT).withColumn("action", F.lit("grant"))
    revoke = present(on_tables(losing), grants, GRANT).withColumn("action", F.lit("revoke"))
    changed = grant.unionByName(revoke)
    # Looking first costs a scan of the changes and saves the whole sync without one.
    if pairs.where(F.col("user_id") == EVERYBODY).isEmpty():
        return changed
    everything = full_sync(permissions, table_names, grants).unionByName(
        public_sync(permissions, table_names, grants)
    )
    return changed.unionByName(everything).distinct()


def user_schemas_to_create(permissions: DataFrame, databases: DataFrame, root: str) -> DataFrame:
    """Schemas of users with READ anywhere that do not exist yet."""
    users = readers(permissions).where(F.col("user_id") != EVERYBODY).select("user_id").distinct()
    return missing(_schemas_of(users, root), databases, ["db_name"])


def changed_user_schemas(changes: DataFrame, databases: DataFrame, root: str) -> DataFrame:
    """Schemas that changed users lack. A change makes its user's schema, whatever it grants or takes."""
    users = changes.where(F.col("user_id") != EVERYBODY).select("user_id").distinct()
    return missing(_schemas_of(users, root), databases, ["db_name"])


def _schemas_of(users: DataFrame, root: str) -> DataFrame:
    return users.select(
        names.user_schema(F.col("user_id")).alias("db_name"),
        names.user_schema_location(root, F.col("user_id")).alias("location"),
        F.lower("user_id").alias("owner"),
    ).distinct()


# Roles ---------------------------------------------------------------------


def role_of_database(databases: DataFrame, groups: DataFrame, roles: RoleNames) -> DataFrame:
    """The last group whose name starts with an access prefix and the database.

    `groups` has `group_cn` and `ordinal`. Every leading part of the rest of a
    group's name is a key, so the prefix match is an equi-join; the last group
    per key is found before it meets the databases.
    """
    cn = F.lower("group_cn")
    rest = F.regexp_extract(cn, f"^{roles.prefix}(ro|rw|w)_(.*)$", 2)
    prefixes = F.transform(F.sequence(F.lit(1), F.length(rest)), lambda n: F.substr(rest, F.lit(1), n))
    wanted = databases.select("db_name").distinct().withColumn("_prefix", F.lower("db_name"))
    last = (
        groups.where(rest != "")
        .select("ordinal", cn.alias("role"), F.explode(prefixes).alias("_prefix"))
        .groupBy("_prefix")
        .agg(F.max(F.struct("ordinal", "role"))["role"].alias("role"))
    )
    return wanted.join(last, "_prefix", "left").select(
        "db_name", F.coalesce("role", F.lit(roles.everyone)).alias("role_name")
    )


def role_of_group(group_cn: Column, roles: RoleNames) -> Column:
    """Role a directory group stands for."""
    cn = F.lower(group_cn)
    return F.when(cn == roles.users_group, F.lit(roles.everyone)).otherwise(cn)


def roles_to_create(database_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Roles that databases map to and that do not exist yet."""
    return missing(database_roles.select("role_name").distinct(), roles, ["role_name"])


def membership_sync(
    members: DataFrame,
    role_users: DataFrame,
    database_roles: DataFrame,
    roles: RoleNames,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Role memberships to grant and to revoke.

    `members` has `group_cn` and `member_dn`, `database_roles` the roles databases
    map to: only those gain members. Any role a group stands for loses whoever left
    the group. `groups` lists all groups by `group_cn`; without it, a group whose
    last member left is not seen.
    """
    listed = members if groups is None else groups
    standing = listed.select(role_of_group(F.col("group_cn"), roles).alias("role_name")).distinct()
    in_group = members.select(
        role_of_group(F.col("group_cn"), roles).alias("role_name"),
        directory.member_user(F.col("member_dn")).alias("user"),
    ).distinct()
    wanted = in_group.join(database_roles.select("role_name").distinct(), "role_name", "left_semi")
    current = role_users.join(standing, "role_name", "left_semi")
    key = ["role_name", "user"]
    return (
        missing(wanted, role_users, key)
        .withColumn("action", F.lit("grant"))
        .unionByName(missing(current.select(*key).distinct(), in_group, key).withColumn("action", F.lit("revoke")))
    )


def role_table_grants(
    database_roles: DataFrame, table_names: DataFrame, grants: DataFrame
) -> DataFrame:
    """SELECT on all tables for read-only roles, where it is missing."""
    reading = database_roles.where(F.lower("role_name").contains("_acl_ro_"))
    wanted = table_names.join(reading, "db_name").select(*_select_of("ROLE", F.col("role_name")))
    return missing(wanted, grants, GRANT)


def unsupported_roles(database_roles: DataFrame) -> DataFrame:
    """Roles that may write; no table privileges are defined for them."""
    return database_roles.where(~F.lower("role_name").contains("_acl_ro_"))


def user_schema_grants(users: DataFrame, table_names: DataFrame, grants: DataFrame) -> DataFrame:
    """The four privileges, with grant option, users lack on tables of their own schema."""
    own = users.select("user", names.user_schema(F.col("user"), fold_case=False).alias("db_name"))
    every = F.explode(F.array(*[F.lit(p) for p in SCHEMA_PRIVILEGES]))
    wanted = table_names.join(own, "db_name").withColumn("privilege", every)
    # A privilege counts as present whoever holds it.
    return missing(wanted, grants, ["db_name", "tbl_name", "privilege"]).select(
        F.lit("USER").alias("principal_type"),
        F.col("user").alias("principal"),
        "db_name",
        "tbl_name",
        "privilege",
        F.lit(True).alias("grant_option"),
    )


def user_schemas(users: DataFrame, databases: DataFrame, existing: bool) -> DataFrame:
    """Users' schemas that exist, or those that do not."""
    own = users.select("user", names.user_schema(F.col("user"), fold_case=False).alias("db_name"))
    found = present if existing else missing
    return found(own, databases, ["db_name"])


# Decisions and reports -----------------------------------------------------


def has_select(asked: DataFrame, grants: DataFrame) -> DataFrame:
    """Asked (principal type, principal, table) rows that hold SELECT."""
    holding = grants.where(F.col("privilege") == "SELECT")
    return present(asked, holding, ["principal_type", "principal", "db_name", "tbl_name"])


def decisions(asked: DataFrame, grants: DataFrame, role_users: DataFrame) -> DataFrame:
    """Whether each (user, table) may be read: by the user's own grant, by the
    public role or by a role the user is in. Names compare case-sensitively."""
    table = ["db_name", "tbl_name"]
    select = grants.where(F.col("privilege") == "SELECT")
    own = select.where("principal_type = 'USER'").select(F.col("principal").alias("user"), *table)
    by_role = select.where("principal_type = 'ROLE'")
    public = by_role.where(F.col("principal") == PUBLIC_ROLE).select(*table).distinct()
    roles = by_role.where(F.col("principal") != PUBLIC_ROLE).select(
        F.col("principal").alias("role_name"), *table
    ).distinct()
    # Ask per role of the user instead of spelling out what all members may read.
    questions = asked.select("user", *table).distinct()
    via_role = (
        questions.join(role_users, "user")
        .join(roles, ["role_name", *table], "left_semi")
        .select("user", *table)
    )
    yes = own.unionByName(via_role).distinct().withColumn("_yes", F.lit(True))
    return (
        asked.join(yes, ["user", *table], "left")
        .join(public.withColumn("_public", F.lit(True)), table, "left")
        .select(
            *asked.columns,
            (F.coalesce("_yes", F.lit(False)) | F.coalesce("_public", F.lit(False))).alias("allowed"),
        )
    )


def revoke_all(grants: DataFrame, role_users: DataFrame, roles: DataFrame) -> DataFrame:
    """Every grant, every member of an access role, and every access role, to remove."""
    access = F.lower("role_name").contains("_acl_")
    of_tables = grants.select(
        F.lit("grant").alias("kind"), "principal_type", "principal",
        F.concat_ws(".", "db_name", "tbl_name").alias("object"), "privilege",
    )
    of_members = role_users.where(access).select(
        F.lit("member").alias("kind"), F.lit("USER").alias("principal_type"),
        F.col("user").alias("principal"), F.col("role_name").alias("object"),
        F.lit("MEMBER").alias("privilege"),
    )
    of_roles = roles.where(access).select(
        F.lit("role").alias("kind"), F.lit("ROLE").alias("principal_type"),
        F.col("role_name").alias("principal"), F.col("role_name").alias("object"),
        F.lit("DROP").alias("privilege"),
    )
    return of_tables.unionByName(of_members).unionByName(of_roles)


def access_report(
    members: DataFrame, roles: DataFrame, role_map: DataFrame,
    databases: DataFrame, tables: DataFrame, grants: DataFrame,
) -> DataFrame:
    """Groups with members, access roles with principals, tables with grants; a row each."""
    groups = members.select(
        F.lit("group").alias("section"), F.col("group_cn").alias("name"),
        F.col("member_dn").alias("entry"),
    )
    principals = (
        attach_rows(roles.where(F.lower("role_name").contains("_acl_")), role_map, ["role_id"])
        .select(
            F.lit("role").alias("section"), F.col("role_name").alias("name"),
            F.coalesce(F.concat_ws(" ", "principal_type", "principal_name"), F.lit("")).alias("entry"),
        )
    )
    privileges = table_privileges(databases, tables, grants).select(
        F.lit("table").alias("section"), F.concat_ws(".", "db_name", "tbl_name").alias("name"),
        F.concat_ws(" ", "principal_type", "principal", "privilege").alias("entry"),
    )
    return groups.unionByName(principals).unionByName(privileges)


def entitlements(user_roles: DataFrame, role_functions: DataFrame) -> DataFrame:
    """Functions each user may call through any role.

    A role has a bounded list of functions; users may crowd one role, so the
    functions go to the users.
    """
    return join_salted(
        user_roles.select("role_name", "user").distinct(),
        role_functions.select("role_name", "function_name").distinct(),
        ["role_name"],
    ).select("user", "function_name").distinct()
