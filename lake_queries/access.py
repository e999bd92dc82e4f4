"""Catalog joins, permissions, roles and grants."""

from __future__ import annotations

from pyspark.sql import functions as F

from lake_queries.registry import query
from quayside.operators import access, profile

ROLES = access.RoleNames("lake")
CATALOG = r"s3://.*/CATALOG/.*\.db$"
USER_DB = r"user_.*\.db$"

NAMED = "named AS (SELECT db_name, tbl_name, tbl_id FROM tables JOIN databases USING (db_id))"
READERS = """readers AS (SELECT DISTINCT namespace, user_id FROM permission_lists
   WHERE list_contains(string_split(permission_list, ','), 'READ'))"""
WANTED = """wanted AS (SELECT DISTINCT user_id, db_name, tbl_name FROM readers JOIN named ON db_name = lower(namespace)
   WHERE user_id <> '*')"""
PUBLIC = """public_flags AS (SELECT lower(namespace) AS db_name, bool_or(user_id = '*' AND list_contains(string_split(permission_list, ','), 'READ')) AS is_public
   FROM permission_lists GROUP BY 1)"""
ROLE_USERS = """role_users AS (SELECT role_name, principal_name AS "user" FROM roles JOIN role_map USING (role_id) WHERE principal_type = 'USER')"""


def names(lake):
    return access.tables_by_name(lake.databases, lake.tables)


def role_users(lake):
    return access.role_members(lake.roles, lake.role_map)


@query(
    "flt3_locations",
    r"SELECT db_name, regexp_matches(db_location, 's3://.*/CATALOG/.*\.db$') AS application FROM databases WHERE db_name <> 'default'",
    "databases",
)
def locations(lake):
    return lake.databases.where("db_name <> 'default'").select(
        "db_name", F.col("db_location").rlike(CATALOG).alias("application")
    )


@query(
    "flt10_matching_databases",
    "SELECT db_name, tbl_name FROM databases JOIN tables USING (db_id) WHERE contains(db_name, 'b1')",
    "databases tables",
)
def matching_databases(lake):
    return names(lake).where(F.col("db_name").contains("b1"))


@query(
    "jn4_role_members",
    f"WITH {ROLE_USERS} SELECT * FROM role_users",
    "roles role_map",
)
def role_members(lake):
    return role_users(lake).orderBy("role_name")


def objects_sql(pattern: str) -> str:
    return f"""SELECT d.db_name, d.db_location, coalesce(t.tbl_name, '') AS tbl_name FROM databases d LEFT JOIN tables t USING (db_id)
    WHERE d.db_name <> 'default' AND regexp_matches(d.db_location, '{pattern}')"""


def objects(lake, pattern):
    found = access.objects_in(lake.databases, lake.tables, pattern)
    return found.select("db_name", "db_location", F.coalesce("tbl_name", F.lit("")).alias("tbl_name"))


@query("jn5_application_objects", objects_sql(CATALOG), "databases tables")
def application_objects(lake):
    return objects(lake, CATALOG)


@query("jn5_user_objects", objects_sql(USER_DB), "databases tables")
def user_objects(lake):
    return objects(lake, USER_DB)


@query(
    "jn6_table_privileges",
    f"""WITH {NAMED} SELECT db_name, tbl_name, coalesce(principal_type, '') AS principal_type, coalesce(principal, '') AS principal,
      coalesce(privilege, '') AS privilege FROM named LEFT JOIN grants USING (db_name, tbl_name)""",
    "databases tables grants",
)
def table_privileges(lake):
    found = access.table_privileges(lake.databases, lake.tables, lake.grants)
    return found.select(
        "db_name", "tbl_name",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ["principal_type", "principal", "privilege"]],
    )


@query(
    "jn8_misplaced_databases",
    """SELECT db_name, db_location AS recorded, concat('s3://home/', db_name, '.db') AS expected FROM databases
    WHERE db_name LIKE 'user_%' AND db_location <> concat('s3://home/', db_name, '.db')""",
    "databases",
)
def misplaced_databases(lake):
    users = lake.customer.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user"))
    return access.misplaced_databases(lake.databases, users, "s3://home")


@query("agg7_distinct_databases", "SELECT DISTINCT db_name FROM databases JOIN tables USING (db_id)", "databases tables")
def distinct_databases(lake):
    return profile.distinct_databases(names(lake))


@query("agg7_distinct_users", f"WITH {READERS} SELECT DISTINCT user_id FROM readers", "permission_lists")
def distinct_users(lake):
    return profile.distinct_users(lake.permissions)


@query(
    "acl1_readers",
    f"""WITH {READERS} SELECT namespace, user_id, bool_or(user_id = '*') OVER (PARTITION BY namespace) AS is_public FROM readers""",
    "permission_lists",
)
def readers(lake):
    flags = access.public_namespaces(lake.permissions)
    return access.readers(lake.permissions).join(flags, "namespace")


@query(
    "acl2_full_sync",
    f"""WITH {NAMED}, {READERS}, {WANTED} SELECT user_id AS principal, db_name, tbl_name FROM wanted w WHERE NOT EXISTS (
      SELECT 1 FROM grants g WHERE g.principal_type = 'USER' AND g.principal = w.user_id AND g.db_name = w.db_name
      AND g.tbl_name = w.tbl_name AND g.privilege = 'SELECT')""",
    "databases tables permission_lists grants",
)
def full_sync(lake):
    return access.full_sync(lake.permissions, names(lake), lake.grants).select(
        "principal", "db_name", "tbl_name"
    )


PUBLIC_SYNC = f"""public_changes AS (SELECT n.db_name, n.tbl_name, CASE WHEN is_public THEN 'grant' ELSE 'revoke' END AS action
   FROM named n JOIN public_flags USING (db_name) WHERE is_public <> EXISTS (SELECT 1 FROM grants g WHERE g.principal_type = 'ROLE'
   AND g.principal = 'public' AND g.privilege = 'SELECT' AND g.db_name = n.db_name AND g.tbl_name = n.tbl_name))"""


@query(
    "acl3_public_sync",
    f"WITH {NAMED}, {PUBLIC}, {PUBLIC_SYNC} SELECT * FROM public_changes",
    "databases tables permission_lists grants",
)
def public_sync(lake):
    return access.public_sync(lake.permissions, names(lake), lake.grants).select(
        "db_name", "tbl_name", "action"
    )


MEMBERSHIP = f"""{ROLE_USERS},
wanted AS (SELECT DISTINCT CASE WHEN lower(group_cn) = 'app_lake_users' THEN 'app_lake_acl_ro_public' ELSE lower(group_cn) END AS role_name,
   replace(split_part(member_dn, ',', 1), 'cn=', '') AS "user" FROM members)"""


GROUPS = "groups AS (SELECT group_cn, min(ordinal) AS ordinal FROM members GROUP BY 1)"
DB_ROLE = """db_roles AS (SELECT db_name, coalesce((SELECT arg_max(lower(group_cn), ordinal) FROM groups g
   WHERE starts_with(lower(group_cn), concat('app_lake_acl_ro_', d.db_name)) OR starts_with(lower(group_cn), concat('app_lake_acl_rw_', d.db_name))
      OR starts_with(lower(group_cn), concat('app_lake_acl_w_', d.db_name))), 'app_lake_acl_ro_public') AS role_name FROM databases d)"""


def database_roles(lake):
    groups = lake.members.groupBy("group_cn").agg(F.min("ordinal").alias("ordinal"))
    return access.role_of_database(lake.databases, groups, ROLES)


@query(
    "jn7_roles_to_create",
    f"""WITH {GROUPS}, {DB_ROLE} SELECT DISTINCT role_name FROM db_roles WHERE role_name NOT IN (SELECT role_name FROM roles)""",
    "databases members roles",
)
def roles_to_create(lake):
    return access.roles_to_create(database_roles(lake), lake.roles)


# Every group is listed, those too whose members all left: customers of the last nation.
LISTED = """listed AS (SELECT group_cn FROM members UNION SELECT concat('APP_LAKE_ACL_', k, '_db', cast(n AS varchar))
  FROM (SELECT DISTINCT c_nationkey AS n FROM customer), (VALUES ('RO'), ('RW'), ('W')) kinds(k))"""


def listed_groups(lake):
    kinds = F.explode(F.array(F.lit("RO"), F.lit("RW"), F.lit("W")))
    emptied = lake.customer.select("c_nationkey").distinct().withColumn("kind", kinds).select(
        F.concat(F.lit("APP_LAKE_ACL_"), F.col("kind"), F.lit("_db"), F.col("c_nationkey").cast("string")).alias("group_cn")
    )
    return lake.members.select("group_cn").unionByName(emptied).distinct()


STANDING = """standing AS (SELECT CASE WHEN lower(group_cn) = 'app_lake_users' THEN 'app_lake_acl_ro_public' ELSE lower(group_cn) END AS role_name FROM listed)"""
LEFT = """left_group AS (SELECT * FROM role_users WHERE role_name IN (SELECT role_name FROM standing) EXCEPT SELECT * FROM wanted)"""


@query(
    "acl4_membership_sync",
    f"""WITH {MEMBERSHIP}, {GROUPS}, {DB_ROLE}, {LISTED}, {STANDING}, {LEFT}
    SELECT role_name, "user", 'grant' AS action FROM (SELECT * FROM wanted WHERE role_name IN (SELECT role_name FROM db_roles)
      EXCEPT SELECT * FROM role_users)
    UNION ALL SELECT role_name, "user", 'revoke' FROM left_group""",
    "roles role_map members databases",
)
def membership_sync(lake):
    return access.membership_sync(lake.members, role_users(lake), database_roles(lake), ROLES, listed_groups(lake))


@query(
    "set4_members_to_remove",
    f"""WITH {MEMBERSHIP}, {LISTED}, {STANDING}, {LEFT} SELECT role_name, "user" FROM left_group""",
    "roles role_map members",
)
def members_to_remove(lake):
    changes = access.membership_sync(lake.members, role_users(lake), database_roles(lake), ROLES, listed_groups(lake))
    return changes.where("action = 'revoke'").drop("action")


@query("acl5_role_of_database", f"WITH {GROUPS}, {DB_ROLE} SELECT * FROM db_roles", "databases members")
def role_of_database(lake):
    return database_roles(lake)


@query(
    "acl6_role_table_grants",
    f"""WITH {NAMED}, {GROUPS}, {DB_ROLE} SELECT role_name AS principal, db_name, tbl_name FROM named n JOIN db_roles r USING (db_name)
    WHERE contains(role_name, '_acl_ro_') AND NOT EXISTS (SELECT 1 FROM grants g WHERE g.principal_type = 'ROLE' AND g.principal = r.role_name
      AND g.db_name = n.db_name AND g.tbl_name = n.tbl_name AND g.privilege = 'SELECT')""",
    "databases tables members grants",
)
def role_table_grants(lake):
    made = access.role_table_grants(database_roles(lake), names(lake), lake.grants)
    return made.select("principal", "db_name", "tbl_name")


def users(lake):
    return lake.customer.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user"))


@query(
    "acl7_user_schema_grants",
    f"""WITH {NAMED} SELECT substr(db_name, 6) AS principal, db_name, tbl_name, privilege, true AS grant_option
    FROM named n, (VALUES ('SELECT'), ('INSERT'), ('UPDATE'), ('DELETE')) p(privilege) WHERE db_name LIKE 'user_%'
      AND NOT EXISTS (SELECT 1 FROM grants g WHERE g.db_name = n.db_name AND g.tbl_name = n.tbl_name AND g.privilege = p.privilege)""",
    "databases tables grants",
)
def user_schema_grants(lake):
    made = access.user_schema_grants(users(lake), names(lake), lake.grants)
    return made.drop("principal_type")


@query(
    "acl7_missing_user_schemas",
    """SELECT concat('u', cast(c_custkey AS varchar)) AS "user", concat('user_u', cast(c_custkey AS varchar)) AS db_name FROM customer
    WHERE concat('user_u', cast(c_custkey AS varchar)) NOT IN (SELECT db_name FROM databases)""",
    "databases",
)
def missing_user_schemas(lake):
    return access.user_schemas(users(lake), lake.databases, existing=False)


# Changed pairs: each customer in its nation's namespace, and everybody in a supplier's.
CHANGES = """changes AS (SELECT concat('DB', cast(c_nationkey AS varchar)) AS namespace, concat('u', cast(c_custkey AS varchar)) AS user_id FROM customer
  WHERE c_acctbal < 4000)"""


def permission_changes(lake):
    return lake.customer.where("c_acctbal < 4000").select(
        F.concat(F.lit("DB"), F.col("c_nationkey").cast("string")).alias("namespace"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"),
    )


DELTA = f"""delta AS (
  SELECT DISTINCT 'USER' AS principal_type, c.user_id AS principal, n.db_name, n.tbl_name,
    CASE WHEN r.user_id IS NOT NULL THEN 'grant' ELSE 'revoke' END AS action
  FROM changes c JOIN named n ON n.db_name = lower(c.namespace) LEFT JOIN readers r ON r.namespace = c.namespace AND r.user_id = c.user_id
  WHERE (r.user_id IS NOT NULL) <> EXISTS (SELECT 1 FROM grants g WHERE g.principal_type = 'USER' AND g.principal = c.user_id
    AND g.db_name = n.db_name AND g.tbl_name = n.tbl_name AND g.privilege = 'SELECT'))"""


@query(
    "acl8_delta_sync",
    f"WITH {NAMED}, {READERS}, {CHANGES}, {DELTA} SELECT * FROM delta",
    "databases tables permission_lists grants",
)
def delta_sync(lake):
    made = access.delta_sync(permission_changes(lake), lake.permissions, names(lake), lake.grants)
    return made.drop("privilege")


@query(
    "acl8_delta_sync_for_everybody",
    f"""WITH {NAMED}, {READERS}, {WANTED}, {PUBLIC}, {PUBLIC_SYNC}, {CHANGES}, {DELTA}
    SELECT * FROM delta UNION SELECT 'USER', user_id, db_name, tbl_name, 'grant' FROM wanted w WHERE NOT EXISTS (
      SELECT 1 FROM grants g WHERE g.principal_type = 'USER' AND g.principal = w.user_id AND g.db_name = w.db_name
      AND g.tbl_name = w.tbl_name AND g.privilege = 'SELECT')
    UNION SELECT 'ROLE', 'public', db_name, tbl_name, action FROM public_changes""",
    "databases tables permission_lists grants",
)
def delta_sync_for_everybody(lake):
    everybody = lake.supplier.select(
        F.concat(F.lit("DB"), F.col("s_suppkey").cast("string")).alias("namespace"), F.lit("*").alias("user_id")
    )
    changes = permission_changes(lake).unionByName(everybody)
    made = access.delta_sync(changes, lake.permissions, names(lake), lake.grants)
    return made.drop("privilege")


# Who may read what: each line item's customer asks for the part's table.
ASKED = f"""asked AS (SELECT DISTINCT concat('u', cast(o_custkey AS varchar)) AS "user", db_name, tbl_name
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN named ON tbl_id = l_partkey)"""


def asked(lake):
    located = lake.tables.join(lake.databases, "db_id")
    return (
        lake.lineitem.join(lake.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(located, F.col("tbl_id") == F.col("l_partkey"))
        .select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"), "db_name", "tbl_name")
        .distinct()
    )


@query(
    "acl9_has_select",
    f"""WITH {NAMED}, {ASKED} SELECT "user" AS principal, db_name, tbl_name FROM asked a WHERE EXISTS (SELECT 1 FROM grants g
      WHERE g.principal_type = 'USER' AND g.principal = a."user" AND g.db_name = a.db_name AND g.tbl_name = a.tbl_name AND g.privilege = 'SELECT')""",
    "databases tables grants",
)
def has_select(lake):
    question = asked(lake).withColumnRenamed("user", "principal").withColumn("principal_type", F.lit("USER"))
    return access.has_select(question, lake.grants).drop("principal_type")


@query(
    "acl10_revoke_all",
    f"""WITH {ROLE_USERS}
    SELECT 'grant' AS kind, principal_type, principal, concat(db_name, '.', tbl_name) AS object, privilege FROM grants
    UNION ALL SELECT 'member', 'USER', "user", role_name, 'MEMBER' FROM role_users WHERE contains(role_name, '_acl_')
    UNION ALL SELECT 'role', 'ROLE', role_name, role_name, 'DROP' FROM roles WHERE contains(role_name, '_acl_')""",
    "grants roles role_map",
)
def revoke_all(lake):
    return access.revoke_all(lake.grants, role_users(lake), lake.roles)


@query(
    "acl11_access_report",
    f"""WITH {NAMED} SELECT 'group' AS section, group_cn AS name, member_dn AS entry FROM members
    UNION ALL SELECT 'role', role_name, coalesce(concat_ws(' ', principal_type, principal_name), '') FROM roles LEFT JOIN role_map USING (role_id)
      WHERE contains(role_name, '_acl_')
    UNION ALL SELECT 'table', concat(db_name, '.', tbl_name), concat_ws(' ', principal_type, principal, privilege)
      FROM named LEFT JOIN grants USING (db_name, tbl_name)""",
    "members roles role_map databases tables grants",
)
def access_report(lake):
    return access.access_report(
        lake.members, lake.roles, lake.role_map, lake.databases, lake.tables, lake.grants
    )


@query(
    "acl12_decisions",
    f"""WITH {NAMED}, {ASKED}, {ROLE_USERS} SELECT a.*, EXISTS (SELECT 1 FROM grants g WHERE g.db_name = a.db_name AND g.tbl_name = a.tbl_name
       AND g.privilege = 'SELECT' AND (g.principal_type = 'USER' AND g.principal = a."user" OR g.principal_type = 'ROLE' AND (g.principal = 'public'
       OR EXISTS (SELECT 1 FROM role_users r WHERE r.role_name = g.principal AND r."user" = a."user")))) AS allowed FROM asked a""",
    "databases tables grants roles role_map",
)
def decisions(lake):
    return access.decisions(asked(lake), lake.grants, role_users(lake))


# Roles of neighbouring suppliers in fours: each holds the next one, and in every second four the last holds the first.
CHAINS = """SELECT a.role_id, b.role_name AS principal_name, 'ROLE' AS principal_type FROM roles a JOIN roles b
      ON b.role_id = CASE WHEN a.role_id % 4 < 3 THEN a.role_id + 1 WHEN a.role_id % 8 = 7 THEN a.role_id - 3 END WHERE a.role_id > 0"""
NESTED = f"""nested AS (SELECT role_id, principal_name, principal_type FROM role_map UNION ALL {CHAINS}),
    links AS (SELECT DISTINCT r.role_name, n.principal_name AS member_role FROM nested n JOIN roles r USING (role_id)
      WHERE principal_type = 'ROLE' AND principal_name IN (SELECT role_name FROM roles)),
    reached AS (SELECT role_name, member_role FROM links UNION SELECT r.role_name, l.member_role FROM reached r JOIN links l ON l.role_name = r.member_role),
    own AS (SELECT role_name, principal_name AS "user" FROM nested JOIN roles USING (role_id) WHERE principal_type = 'USER'),
    role_users AS (SELECT role_name, "user" FROM own UNION SELECT r.role_name, o."user" FROM reached r JOIN own o ON o.role_name = r.member_role)"""


def nested_role_map(lake):
    """The role map with roles as members of roles, in chains and cycles."""
    at = F.col("role_id")
    held = F.when(at % 4 < 3, at + 1).when(at % 8 == 7, at - 3)
    chains = lake.roles.where("role_id > 0").select("role_id", held.alias("held")).join(
        lake.roles.select(at.alias("held"), F.col("role_name").alias("principal_name")), "held"
    )
    return lake.role_map.unionByName(chains.select("role_id", "principal_name", F.lit("ROLE").alias("principal_type")))


@query("jn4_nested_role_members", f"WITH RECURSIVE {NESTED} SELECT * FROM role_users", "roles role_map")
def nested_role_members(lake):
    """Users of each role with those of the roles it holds, through chains and cycles."""
    return access.all_role_members(lake.roles, nested_role_map(lake))


@query(
    "acl12_nested_decisions",
    f"""WITH RECURSIVE {NAMED}, {ASKED}, {NESTED} SELECT a.*, EXISTS (SELECT 1 FROM grants g WHERE g.db_name = a.db_name AND g.tbl_name = a.tbl_name
       AND g.privilege = 'SELECT' AND (g.principal_type = 'USER' AND g.principal = a."user" OR g.principal_type = 'ROLE' AND (g.principal = 'public'
       OR EXISTS (SELECT 1 FROM role_users r WHERE r.role_name = g.principal AND r."user" = a."user")))) AS allowed FROM asked a""",
    "databases tables grants roles role_map",
)
def nested_decisions(lake):
    """Who may read what where roles hold roles."""
    return access.decisions(asked(lake), lake.grants, access.all_role_members(lake.roles, nested_role_map(lake)))


@query(
    "acl13_entitlements",
    f"""WITH {ROLE_USERS} SELECT DISTINCT "user", concat('FN_', p_type, '_', cast(p_size AS varchar)) AS function_name
    FROM role_users JOIN (SELECT role_id, role_name FROM roles) USING (role_name)
    JOIN part ON cast(floor(p_partkey / 20) AS bigint) = role_id""",
    "roles role_map",
)
def entitlements(lake):
    functions = lake.part.select(
        F.floor(F.col("p_partkey") / 20).alias("role_id"),
        F.concat(F.lit("FN_"), "p_type", F.lit("_"), F.col("p_size").cast("string")).alias("function_name"),
    ).join(lake.roles, "role_id")
    return access.entitlements(role_users(lake), functions)


@query(
    "acl14_user_schemas_to_drop",
    """SELECT concat('u', cast(c_custkey AS varchar)) AS "user", db_name FROM customer
    JOIN databases ON db_name = concat('user_u', cast(c_custkey AS varchar))""",
    "databases",
)
def user_schemas_to_drop(lake):
    return access.user_schemas(users(lake), lake.databases, existing=True)


@query(
    "acl8_user_schemas_to_create",
    f"""WITH {READERS} SELECT DISTINCT concat('user_', user_id) AS db_name, concat('s3://home/user_', user_id, '.db') AS location,
      user_id AS owner FROM readers WHERE user_id <> '*' AND concat('user_', user_id) NOT IN (SELECT db_name FROM databases)""",
    "permission_lists databases",
)
def user_schemas_to_create(lake):
    return access.user_schemas_to_create(lake.permissions, lake.databases, "s3://home")
