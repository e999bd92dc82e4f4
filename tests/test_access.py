from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import access

ROLES = access.RoleNames("lake")
GRANTS = "principal_type string, principal string, db_name string, tbl_name string, privilege string"


def permissions(spark, *rows):
    return spark.createDataFrame(list(rows), "namespace string, user_id string, permissions array<string>")


def grants(spark, *rows):
    return spark.createDataFrame(list(rows), GRANTS)


def tables(spark, *names):
    return spark.createDataFrame([tuple(n.split(".")) for n in names], "db_name string, tbl_name string")


def applied(held, changes):
    """Grants after the changes."""
    granted = changes.where("action = 'grant'").select(*held.columns)
    revoked = changes.where("action = 'revoke'").select(*held.columns)
    return held.join(revoked, held.columns, "left_anti").unionByName(granted)


def may(spark, held, user, members=()):
    asked = spark.createDataFrame([(user, "mine", "t")], "user string, db_name string, tbl_name string")
    of = spark.createDataFrame(list(members), "role_name string, user string")
    return access.decisions(asked, held, of).first().allowed


def delta(spark, user, current, held):
    changed = spark.createDataFrame([("MINE", user)], "namespace string, user_id string")
    return access.delta_sync(changed, current, tables(spark, "mine.t"), held)


def test_grant_and_revoke_of_one_user(spark):
    held = grants(spark)
    assert not may(spark, held, "ann")
    reading = permissions(spark, ("MINE", "ann", ["READ"]))
    held = applied(held, delta(spark, "ann", reading, held))
    assert may(spark, held, "ann") and not may(spark, held, "ANN") and not may(spark, held, "bob")
    assert delta(spark, "ann", reading, held).count() == 0
    without = permissions(spark, ("MINE", "ann", ["WRITE"]))
    held = applied(held, delta(spark, "ann", without, held))
    assert not may(spark, held, "ann")


def test_everybody(spark):
    held = grants(spark)
    public = permissions(spark, ("MINE", "*", ["READ"]))
    held = applied(held, delta(spark, "*", public, held))
    assert may(spark, held, "ann") and may(spark, held, "bob")
    private = permissions(spark, ("MINE", "*", ["WRITE"]))
    held = applied(held, delta(spark, "*", private, held))
    assert not may(spark, held, "ann") and not may(spark, held, "bob")


def test_a_namespace_without_tables_gives_nothing(spark):
    reading = permissions(spark, ("OTHER", "ann", ["READ"]))
    changed = spark.createDataFrame([("OTHER", "ann")], "namespace string, user_id string")
    assert access.delta_sync(changed, reading, tables(spark, "mine.t"), grants(spark)).count() == 0


def test_full_sync_only_grants_unless_told(spark, rows):
    current = permissions(spark, ("MINE", "ann", ["READ"]), ("MINE", "*", ["READ"]))
    held = grants(spark, ("USER", "bob", "mine", "t", "SELECT"))
    found = access.full_sync(current, tables(spark, "mine.t"), held)
    assert rows(found) == [("USER", "ann", "mine", "t", "SELECT", "grant")]
    found = access.full_sync(current, tables(spark, "mine.t"), held, full_revoke=True)
    assert rows(found) == [
        ("USER", "ann", "mine", "t", "SELECT", "grant"), ("USER", "bob", "mine", "t", "SELECT", "revoke"),
    ]


def test_a_crowded_namespace_gets_every_pair(spark):
    users = spark.range(400).select(
        F.lit("MINE").alias("namespace"), F.concat(F.lit("u"), "id").alias("user_id"), F.array(F.lit("READ")).alias("permissions")
    )
    many = spark.range(30).select(F.lit("mine").alias("db_name"), F.concat(F.lit("t"), "id").alias("tbl_name"))
    assert access.full_sync(users, many, grants(spark)).distinct().count() == 400 * 30


def test_roles_decide_too(spark):
    held = grants(spark, ("ROLE", "app_lake_acl_ro_mine", "mine", "t", "SELECT"))
    assert may(spark, held, "ann", [("app_lake_acl_ro_mine", "ann")])
    assert not may(spark, held, "bob", [("app_lake_acl_ro_mine", "ann")])


def test_role_of_a_database(spark):
    databases = spark.createDataFrame([("mine",), ("other",), ("min",)], "db_name string")
    groups = spark.createDataFrame(
        [("APP_LAKE_ACL_RO_mine", 1), ("app_lake_acl_rw_MINE_x", 2), ("APP_LAKE_Users", 3), ("x_APP_LAKE_ACL_RO_other", 4)],
        "group_cn string, ordinal int",
    )
    found = access.role_of_database(databases, groups, ROLES).collect()
    # The database name is a prefix of the rest, and the last group wins.
    assert {r.db_name: r.role_name for r in found} == {
        "mine": "app_lake_acl_rw_mine_x", "min": "app_lake_acl_rw_mine_x", "other": "app_lake_acl_ro_public",
    }
    roles = spark.createDataFrame([("mine", "app_lake_acl_rw_mine")], "db_name string, role_name string")
    assert access.role_table_grants(roles, tables(spark, "mine.t"), grants(spark)).count() == 0
    assert access.unsupported_roles(roles).count() == 1


def test_membership(spark, rows):
    members = spark.createDataFrame(
        [("APP_LAKE_Users", "cn=ann,ou=x"), ("APP_LAKE_ACL_RO_mine", "cn=bob,ou=x"), ("APP_LAKE_ACL_RW_nodb", "cn=bob,ou=x")],
        "group_cn string, member_dn string",
    )
    current = spark.createDataFrame(
        [("app_lake_acl_ro_public", "old"), ("app_lake_acl_ro_mine", "bob"), ("unrelated", "eve"), ("app_lake_acl_w_gone", "dan")],
        "role_name string, user string",
    )
    mapped = spark.createDataFrame(
        [("mine", "app_lake_acl_ro_mine"), ("x", "app_lake_acl_ro_public")], "db_name string, role_name string"
    )
    groups = spark.createDataFrame([(g,) for g in ("APP_LAKE_Users", "APP_LAKE_ACL_RO_mine", "APP_LAKE_ACL_W_gone")], "group_cn string")
    # No grant for a group without a database; an emptied group loses its last member.
    assert rows(access.membership_sync(members, current, mapped, ROLES, groups)) == [
        ("app_lake_acl_ro_public", "ann", "grant"), ("app_lake_acl_ro_public", "old", "revoke"),
        ("app_lake_acl_w_gone", "dan", "revoke"),
    ]
    existing = spark.createDataFrame([("app_lake_acl_ro_mine",)], "role_name string")
    assert rows(access.roles_to_create(mapped, existing)) == [("app_lake_acl_ro_public",)]


def test_schemas_of_changed_users(spark):
    changes = spark.createDataFrame([("NS", "Ann"), ("NS", "bob"), ("NS", "*")], "namespace string, user_id string")
    databases = spark.createDataFrame([("user_bob",)], "db_name string")
    made = access.changed_user_schemas(changes, databases, "s3://home").collect()
    assert [(r.db_name, r.owner) for r in made] == [("user_ann", "ann")]


def test_own_schema(spark):
    users = spark.createDataFrame([("ann",), ("bob",)], "user string")
    held = grants(spark, ("USER", "ann", "user_ann", "t", "SELECT"))
    made = access.user_schema_grants(users, tables(spark, "user_ann.t"), held).collect()
    assert sorted(r.privilege for r in made) == ["DELETE", "INSERT", "UPDATE"]
    assert all(r.grant_option and r.principal == "ann" for r in made)
    databases = spark.createDataFrame([("user_ann", "s3://old/user_ann.db")], "db_name string, db_location string")
    assert [r.user for r in access.user_schemas(users, databases, existing=False).collect()] == ["bob"]
    wrong = access.misplaced_databases(databases, users, "s3://home").first()
    assert wrong.expected == "s3://home/user_ann.db"
