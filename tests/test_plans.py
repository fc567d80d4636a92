"""Plans: outcomes, guards, and that a second run changes nothing."""

from datetime import datetime
from conftest import DIR, FILE, LINK, column, pairs
from pyspark.sql import functions as F

import pytest

from treecensus.operators import identity, search, snapshots
from treecensus.functions import aces as A
from treecensus.options import OptionError, ace_full, ace_key, ace_rights
from treecensus.plans import acl, marks, restore, transfer

OBJECT = f"path string, type string, id string, owner string, `group` string, acl {A.ACL}"


def ace(text, inherited=False):
    kind, flags, who, rights = text.split(":")
    return (kind, who, list(flags) + (["INHERITED"] if inherited else []), list(rights))


def objects(spark, *rows):
    return spark.createDataFrame(
        [(p, FILE, f"id{p}", "o", "g", ([], [], list(entries))) for p, *entries in rows], OBJECT)


def texts(plan, which="after"):
    return {r.path: (r.action, r.t) for r in plan.select(
        "path", "action", A.trustee_texts(F.col(f"{which}.aces")).alias("t")).collect()}


EDITS = [
    A.remove(*ace_key("Allow:Everyone")), A.add(*ace_full("Allow:fd:Everyone:Modify")),
    A.add(*ace_full("Deny::new:w")), A.replace(*ace_full("Allow:f:Everyone:rx")),
    A.add_rights(*ace_rights("Allow:Everyone:x")), A.remove_rights(*ace_rights("Allow:Everyone:r")),
    A.clone("Everyone", "copy"), A.clone("bob", "Everyone", sync=True),
    A.chain(A.remove(*ace_key("Deny:bob")), A.add(*ace_full("Deny::Everyone:d"))),
]


@pytest.mark.parametrize("edit", EDITS)
def test_a_second_edit_changes_nothing(spark, edit):
    start = objects(spark, ("/a", ace("Allow::Everyone:r"), ace("Allow:fd:bob:rwx"), ace("Deny::bob:w")),
                    ("/b", ace("Allow::ann:r", True), ace("Allow::Everyone:rw", True)), ("/c",))
    plan = acl.edit_aces(start, edit)
    again = acl.edit_aces(start.drop("acl").join(plan.select("path", F.col("after").alias("acl")), "path"), edit)
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_edits(spark):
    start = objects(spark, ("/a", ace("Allow::du:r"), ace("Allow::x:r"), ace("Allow::du:w"), ace("Allow::du:x")))

    def after(edit):
        return texts(acl.edit_aces(start, edit))["/a"]

    assert after(A.replace_new(ace_key("Allow:du"), ace_full("Allow:fd:du:Modify"))) == (
        "change", ["Allow:fd:du:rwaxdtTnNcy", "Allow::x:r"])
    assert after(A.replace_new(ace_key("Deny:du"), ace_full("Allow:fd:du:r")))[0] == "unchanged"
    assert after(A.replace(*ace_full("Allow::nobody:r")))[0] == "unchanged"
    assert after(A.remove_rights(*ace_rights("Allow:du:r"))) == ("change", ["Allow::x:r", "Allow::du:w", "Allow::du:x"])
    assert after(A.add(*ace_full("Deny::du:w"))) == (
        "change", ["Deny::du:w", "Allow::du:r", "Allow::x:r", "Allow::du:w", "Allow::du:x"])


def test_clone_matrix(spark):
    rows = objects(spark, ("/new", ace("Allow:fd:alice:rw"), ace("Deny::alice:x")),
                   ("/has", ace("Allow:fd:alice:rw"), ace("Deny::alice:x"), ace("Allow::bob:r")))
    plain = texts(acl.edit_aces(rows, A.clone("alice", "bob")))
    assert sorted(plain["/new"][1]) == sorted(["Allow:fd:alice:rw", "Deny::alice:x", "Allow:fd:bob:rw", "Deny::bob:x"])
    assert sorted(plain["/has"][1]) == sorted(["Allow:fd:alice:rw", "Deny::alice:x", "Allow::bob:r", "Deny::bob:x"])
    synced = texts(acl.edit_aces(rows, A.clone("alice", "bob", sync=True)))
    assert sorted(synced["/has"][1]) == sorted(["Allow:fd:alice:rw", "Deny::alice:x", "Allow::bob:rw", "Deny::bob:x"])


def test_an_inherited_entry_breaks_inheritance_on_the_root_only(spark):
    rows = objects(spark, ("/r", ace("Allow::bob:rw", True), ace("Allow::ann:r", True)),
                   ("/r/x", ace("Allow::bob:rw", True), ace("Allow::ann:r", True)), ("/other", ace("Allow::bob:rw")))
    kind, who, rights = ace_rights("Allow:bob:w")
    plan = acl.edit_aces(rows, A.remove_rights(kind, who, rights), A.matches(kind, who), root="/r")
    got = {r.path: (list(r.after.control), [list(a.flags) for a in r.after.aces]) for r in plan.collect()}
    assert got == {"/r": (["PROTECTED"], [[], []]), "/r/x": ([], [["INHERITED"], ["INHERITED"]])}
    only = acl.edit_aces(rows, A.remove_rights(kind, who, rights), A.matches(kind, who), root="/r", propagate=False)
    assert column(only) == ["/r"]


def test_inheritance_modes_and_copies(spark):
    rows = objects(spark, ("/t", ace("Allow:fd:bob:r")), ("/t/x", ace("Allow::ann:r", True)), ("/src", ace("Deny::z:w")))
    cut = acl.disable_inheritance(rows, remove_inherited=True)
    assert {r.path: r.left_empty for r in cut.collect()} == {"/t": False, "/t/x": True, "/src": False}
    copied = {r.path: r for r in acl.copy_acl(rows, "/src", "/t").collect()}
    assert [list(a.flags) for a in copied["/t"].after.aces] == [[]]
    assert [list(a.flags) for a in copied["/t/x"].after.aces] == [["INHERITED"]]
    assert set(copied) == {"/t", "/t/x"}


def test_modes(spark):
    rows = spark.createDataFrame([("/d", DIR, "1", "o", "g", None), ("/d/f", FILE, "2", "o", "g", None)], OBJECT)
    got = {r.path: (list(r.after.posix_special), r.new_owner) for r in acl.set_mode(rows, "3755", owner="uid:1").collect()}
    assert got == {"/d": (["SET_GID", "STICKY_BIT"], "uid:1"), "/d/f": (["STICKY_BIT"], "uid:1")}
    assert texts(acl.set_mode(rows, "0750"))["/d"] == ("change", ["Allow::OWNER@:rwax", "Allow::GROUP@:rx"])
    assert column(acl.set_mode(rows, "644", kind="file")) == ["/d/f"]


@pytest.mark.parametrize("saved,root", [
    (["/a/x", "/a/y", "/b"], "/"), (["/a/x", "/a/y"], "/a"), (["/a/x"], "/a/x"), (["/a", "/a/x", "/a/y/z"], "/a"),
    (["/ab", "/a/x"], "/"), (["/d/ab", "/d/a", "/d/a/c", "/d/a!"], "/d"), (["/", "/q"], "/"), (["/d/a/1", "/d/a/2", None], "/d/a")])
def test_a_backup_is_restored_elsewhere(spark, saved, root):
    none = "struct<control:array<string>,posix_special:array<string>,aces:array<struct<type:string,trustee:string,flags:array<string>,rights:array<string>>>>"
    rows = spark.createDataFrame([(p, "1", None) for p in saved], f"path string, file_id string, acl {none}")
    live = spark.createDataFrame([], f"path string, id string, acl {none}")
    got = [r.path for r in acl.restore(rows, live, target="/t/").collect()]
    bare = root.rstrip("/")
    assert sorted(got) == sorted("/t" if p == root else "/t" + p[len(bare):] for p in saved if p)


def test_restore_guards_the_file_id(spark):
    rows = objects(spark, ("/a", ace("Allow::x:r")), ("/b", ace("Allow::x:r")))
    saved = spark.createDataFrame([("/a", "id/a", ([], [], [ace("Allow::y:r")])), ("/b", "other", ([], [], [])),
                                   ("/gone", "id", ([], [], []))], f"path string, file_id string, acl {A.ACL}")
    assert pairs(acl.restore(saved, rows), "path", "action") == {("/a", "restore"), ("/b", "refused"), ("/gone", "missing")}
    assert ("/b", "restore") in pairs(acl.restore(saved, rows, force=True), "path", "action")


def test_mappings_are_not_chained(spark, make):
    mapping = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    rows = objects(spark, ("/1", ace("Allow::a:r"), ace("Deny:fd:b:w"), ace("Allow::z:r")), ("/2",))
    small = texts(acl.migrate_trustees(rows, mapping))
    assert small == {"/1": ("change", ["Allow::b:r", "Deny:fd:c:w", "Allow::z:r"]), "/2": ("unchanged", [])}
    owners = make(("/x", {"owner": "a"}), ("/y", {"owner": "c"}))
    assert pairs(acl.change_ownership(owners, mapping), "path", "after") == {("/x", "b"), ("/y", "c")}
    assert column(acl.change_ownership(owners, mapping, root="/x", propagate=False)) == ["/x"]


def test_tags(spark):
    rows = spark.createDataFrame([("/s", {"k": "v", "o": "1"}), ("/d", {"k": "w"}), ("/n", {}), ("/u", None)],
                                 "path string, tags map<string,string>")

    def result(plan):
        return {r.path: (r.action, r.after) for r in plan.collect()}

    assert result(marks.add_tag(rows, "k", "v")) == {
        "/s": ("unchanged", {"k": "v", "o": "1"}), "/d": ("skipped_conflict", {"k": "w"}), "/n": ("add", {"k": "v"}),
        "/u": ("unreadable", None)}
    done = marks.add_tag(rows, "k", "v", overwrite=True)
    assert result(done)["/d"] == ("overwrite", {"k": "v"})
    again = marks.add_tag(done.select("path", F.col("after").alias("tags")), "k", "v", overwrite=True)
    assert {a for a, _ in result(again).values()} == {"unchanged", "unreadable"}
    assert result(marks.remove_tag(rows, "k", "v")) == {
        "/s": ("remove", {"o": "1"}), "/d": ("skipped_value", {"k": "w"}), "/n": ("unchanged", {}), "/u": ("unreadable", None)}


def test_attributes():
    for bad in ({"on": ["hidden"], "off": ["hidden"]}, {"on": ["offline"]}):
        with pytest.raises(OptionError):
            marks.set_attributes(None, **bad)


def actions(plan):
    return pairs(plan, "path", "action")


def test_move_outcomes(make):
    live = make("/a/", "/b/", "/dest/", "/dest/there", "/dest/folder/", "/a/there", "/a/dog", "/b/dog", "/a/folder", "/dest/own")
    rows = make("/a/there", "/a/dog", "/b/dog", "/a/folder", "/dest/own", ("/a/link", {"type": LINK}), "/b/")
    want = {("/a/there", "skip_exists"), ("/a/dog", "skip_multi_source"), ("/b/dog", "skip_multi_source"),
            ("/a/folder", "skip_exists"), ("/dest/own", "skip_noop"), ("/a/link", "move"), ("/b", "skip_directory")}
    assert actions(transfer.transfer_plan(rows, "/dest/", live)) == want
    forced = actions(transfer.transfer_plan(rows, "/dest", live, clobber=True))
    assert forced == want - {("/a/there", "skip_exists")} | {("/a/there", "overwrite")}


def test_directories_travel_once_and_never_into_themselves(make):
    rows = make("/p/", "/p/x", "/p/q/", "/p/q/y", "/dest/", "/z")
    plan = transfer.transfer_plan(rows, "/dest/sub", rows, "copy", include_directories=True)
    assert actions(plan) == {("/p", "copy"), ("/p/x", "pruned"), ("/p/q", "pruned"), ("/p/q/y", "pruned"),
                             ("/dest", "refused_cycle"), ("/z", "copy")}
    spread = transfer.expand_directories(plan, rows)
    assert pairs(spread, "path", "target") == {
        ("/p", "/dest/sub/p"), ("/p/x", "/dest/sub/p/x"), ("/p/q", "/dest/sub/p/q"), ("/p/q/y", "/dest/sub/p/q/y"),
        ("/z", "/dest/sub/z")}


def test_rename_outcomes(make):
    from treecensus.functions.rename import renamer

    live = make("/d/a1", "/d/b1", "/d/c", "/d/x2", "/d/x3", "/d/y")
    plan = transfer.rename_plan(live, renamer(r"{a1|c}{x\d|x}{b1|}"), live)
    assert actions(plan) == {("/d/a1", "skip_exists"), ("/d/b1", "invalid_name"), ("/d/c", "skip_noop"),
                             ("/d/x2", "skip_multi_source"), ("/d/x3", "skip_multi_source"), ("/d/y", "skip_noop")}


def test_sync_is_idempotent(make):
    source = make(("/s/a", {"size": 1}), ("/s/b", {"size": 2}), "/s/c")
    dest = make("/d/", ("/d/a", {"size": 1}), ("/d/b", {"size": 9}))
    plan = transfer.sync_plan(source, "/d", dest)
    assert actions(plan) == {("/s/a", "skip_unchanged"), ("/s/b", "copy_changed"), ("/s/c", "copy_new")}
    copied = source.join(plan.select("path", "target"), "path").withColumn("path", F.col("target")).drop("target")
    assert {a for _, a in actions(transfer.sync_plan(source, "/d", copied))} == {"skip_unchanged"}


def test_restore_and_revert(make, spark):
    from treecensus.operators.snapshots import tree_diff

    saved = make("/a/", "/a/x.txt", "/a/gone", "/a/e/", "/a/e/deep")
    live = make("/a/", ("/a/x.txt", {"size": 5}), "/a/new")
    assert actions(restore.restore_plan(saved, live)) == {
        ("/a/x.txt", "skip_exists"), ("/a/gone", "recreate"), ("/a/e/deep", "recreate")}
    renamed = restore.restore_plan(saved, live, "rename", "_r")
    assert ("/a/x.txt", "/a/x_r.txt") in pairs(renamed, "path", "target")
    whole = restore.restore_plan(saved, live, "clobber", include_directories=True)
    assert {("/a", "merge"), ("/a/e", "recreate"), ("/a/x.txt", "overwrite")} <= actions(whole)
    diff = tree_diff(saved, live)
    assert actions(restore.revert_plan(diff)) == {
        ("/a/x.txt", "restore"), ("/a/gone", "recreate"), ("/a/e/", "recreate"), ("/a/new", "keep")}
    # after the exact rollback nothing is left to do
    assert restore.revert_plan(tree_diff(saved, saved), delete_new=True).count() == 0
    targets = restore.restore_plan(saved, live).where("action = 'recreate'")
    assert column(transfer.missing_directories(targets, live)) == ["/a/e"]


def listed(spark, lists):
    """Objects with lists of (type, trustee), as the ACL functions take them."""
    rows = [(p, "FS_FILE_TYPE_FILE" if p != "/" else "FS_FILE_TYPE_DIRECTORY", p, "o", "g",
             None if a is None else ([], [(t, [], who, ["READ"]) for t, who in a])) for p, a in lists.items()]
    return spark.createDataFrame(rows, "path string, type string, id string, owner string, `group` string, acl struct<"
                                 "control:array<string>,aces:array<struct<type:string,flags:array<string>,trustee:string,rights:array<string>>>>")


def trustees(plan):
    return {r.path: [(a.type, a.trustee) for a in r.after.aces] for r in plan.collect()}


@pytest.mark.parametrize("extra,most", [(0, 5000), (1500, 5000), (1500, 100), (1500, 1)])
def test_migration_is_the_same_for_mappings_of_any_size(spark, monkeypatch, extra, most):
    monkeypatch.setattr(acl, "MOST_MAPPED", most)  # in the row; in the row once unused sources are gone; joined
    objects = listed(spark, {"/a": [("Allow", "a"), ("Deny", "b"), ("Allow", "x"), ("Allow", None), ("Deny", "a")], "/none": [],
                             "/p": [("Allow", "ü\"\\,'")]}).repartition(3)
    odd = [("ü\"\\,'", "{é}\n")]
    more = [(f"s{i}", f"t{i}") for i in range(extra)] + odd
    table = spark.createDataFrame([("a", "b"), ("b", "c"), (None, "z"), ("x", None), ("a", "b"), *more], "source string, target string")
    plan = acl.migrate_trustees(objects, table)
    assert trustees(plan) == {
        "/a": [("Allow", "b"), ("Deny", "c"), ("Allow", "x"), ("Allow", None), ("Deny", "b")], "/none": [], "/p": [("Allow", "{é}\n")]}
    assert pairs(plan, "path", "action") == {("/a", "change"), ("/none", "unchanged"), ("/p", "change")}
    shuffles = plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert (shuffles == 0) == (most > 1)  # no object moves for a mapping in the row
    twice = spark.createDataFrame([("a", "b"), ("a", "c"), *more], "source string, target string")
    with pytest.raises(Exception, match="two targets"):
        acl.migrate_trustees(objects, twice).collect()


def test_a_missing_list_stays_missing_in_a_migration(spark, monkeypatch):
    table = spark.createDataFrame([("a", "b"), ("q", "r")], "source string, target string")
    rows = listed(spark, {"/a": [("Allow", "a"), ("Deny", "q")]}).unionByName(
        listed(spark, {"/n": []}).withColumn("acl", F.lit(None).cast(listed(spark, {"/n": []}).schema["acl"].dataType)))
    for most in (5000, 1):
        monkeypatch.setattr(acl, "MOST_MAPPED", most)
        got = {r.path: (r.action, r.after) for r in acl.migrate_trustees(rows, table).collect()}
        assert got["/n"] == ("unchanged", None) and got["/a"][0] == "change"


def test_a_joined_migration_carries_each_list_once(spark, monkeypatch):
    seen, kept = [], acl.lookup_join
    monkeypatch.setattr(acl, "lookup_join", lambda rows, *a, **k: seen.append(rows) or kept(rows, *a, **k))
    monkeypatch.setattr(acl, "MOST_MAPPED", 1)
    rows = listed(spark, {"/a": [("Allow", "a"), ("Deny", "q"), ("Allow", "z")], "/b": [("Deny", "q")], "/none": []})
    table = spark.createDataFrame([("a", "b"), ("q", "r"), ("z", "y")], "source string, target string")
    plan = acl.migrate_trustees(rows, table)
    assert trustees(plan) == {"/a": [("Allow", "b"), ("Deny", "r"), ("Allow", "y")], "/b": [("Deny", "r")], "/none": []}
    assert seen[0].count() == 5 and seen[0].where("acl IS NOT NULL").count() == 3
    assert {f.dataType.typeName() for f in seen[0].schema if f.name not in ("path", "acl")} == {"integer", "string"}


@pytest.mark.parametrize("sync", [False, True])
def test_cloning_is_the_same_for_mappings_of_any_size(spark, monkeypatch, sync):
    held = {"/a": [("Allow", "a"), ("Deny", "b"), ("Allow", "a")], "/b": [("Allow", "z")], "/none": []}
    objects = listed(spark, held).repartition(3)
    table = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "n1"), ("a", "n1"), (None, "q"), ("a", None),
                                   *((f"s{i}", "t") for i in range(50))], "source string, target string")
    seen = []
    for most in (5000, 10, 1):  # in the row, in the row once unused sources are gone, joined
        monkeypatch.setattr(acl, "MOST_MAPPED", most)
        seen.append(trustees(acl.clone_from_map(objects, table, sync)))
    assert seen[0] == seen[1] == seen[2] and seen[0]["/b"] == held["/b"] and seen[0]["/none"] == []
    assert {who for _, who in seen[0]["/a"]} == {"a", "b", "n1", "n2"}
    nothing = acl.clone_from_map(objects, table.limit(0), sync)
    assert {r.action for r in nothing.collect()} == {"unchanged"}


def test_cloning_never_chains(spark):
    objects = listed(spark, {"/a": [("Allow", "a"), ("Deny", "b")]})
    table = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    got = set(trustees(acl.clone_from_map(objects, table))["/a"])
    assert got == {("Allow", "a"), ("Deny", "b"), ("Allow", "b"), ("Deny", "c")}


def test_a_missing_source_of_a_list_is_an_error(spark):
    objects = listed(spark, {"/": [], "/t": [("Allow", "a")]})
    with pytest.raises(Exception, match="no object to copy"):
        acl.copy_acl(objects, "/nowhere", "/t").collect()
    assert trustees(acl.copy_acl(objects, "/t", "/t")) == {"/t": [("Allow", "a")]}


def test_a_saved_tree_is_rebased(spark):
    objects = listed(spark, {"/new": [], "/new/f": []})
    saved = spark.createDataFrame([("/old", "1"), ("/old/f", "2")], "path string, file_id string").join(
        listed(spark, {"/old": [("Allow", "a")], "/old/f": [("Deny", "b")]}).select("path", "acl"), "path")
    assert trustees(acl.restore(saved, objects, force=True, target="/new")) == {
        "/new": [("Allow", "a")], "/new/f": [("Deny", "b")]}


def test_restore_does_not_merge_into_a_file(make):
    plan = restore.restore_plan(make("/a/", "/a/f", "/b/", "/b/f", "/r"), make("/a", "/b/", "/r", "/r_restored"),
                                "rename", include_directories=True)
    assert {(r.path, r.action, r.target) for r in plan.collect()} == {
        ("/a", "conflict", "/a"), ("/a/f", "conflict", "/a/f"), ("/b", "merge", "/b"), ("/b/f", "recreate", "/b/f"),
        ("/r", "skip_exists", "/r")}
    files = restore.restore_plan(make("/a/", "/a/f"), make("/a"), "clobber")
    assert [(r.path, r.action) for r in files.collect()] == [("/a/f", "conflict")]


def test_revert_folds_a_changed_type(spark, make):
    when = {"modification_time": datetime(2002, 2, 2)}
    diff = snapshots.tree_diff(make("/f", "/same"), make("/f/", "/f/x", ("/same", when)))
    assert {(r.op, r.path) for r in diff.collect()} == {("DELETE", "/f"), ("CREATE", "/f/"), ("MODIFY", "/same")}
    assert {(r.path, r.action) for r in restore.revert_plan(diff).collect()} == {("/f", "replace"), ("/same", "restore")}


def test_owners_that_cannot_be_are_left_out(spark):
    ids = spark.createDataFrame([("1", 7, None, "bob", "ACTIVE_DIRECTORY", "S-1-5"), ("2", 8, 9, "eve", "LOCAL", None)],
                                "auth_id string, uid bigint, gid bigint, name string, domain string, sid string")
    find = lambda *owners, **k: sorted(r[0] for r in identity.resolve_owners(ids, owners, **k).collect())
    assert find("uid:abc") == [] == find("bob", kind="uid") and find("7") == ["1"]
    assert find("S-1-5") == ["1"] == find("CORP\\bob") == find("bob@corp.example") and find("CORP\\eve") == []


def test_ages_count_from_now(make):
    assert search.search(make("/f"), search.Search(older_than=30)).count() == 1
    assert search.search(make("/f"), search.Search(newer_than=30)).count() == 0
