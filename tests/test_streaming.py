import json
import os
import random
from pathlib import Path

import pytest

from tessera.streaming import frames, identity, pushes, sync
from tessera.streaming.published import Published
from tessera.streaming.state import keyed_state

CHANGE = ("path", "content", "status", "previous_path", "commit_sha")


def land(folder, name, *changes):
    (folder / name).write_text("".join(json.dumps(dict(zip(CHANGE, c, strict=True))) + "\n" for c in changes))


def chunks(spark, root, buckets=64):
    return {(r["path"], r["content"]): r["commit_sha"] for r in sync.index(str(root), buckets).read(spark, "chunks").collect()}


def test_change_feed_becomes_an_index(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    run = lambda: sync.start_sync(spark, str(landing), str(tmp_path / "index"), str(tmp_path / "state"), 2, 0).awaitTermination()
    assert chunks(spark, tmp_path / "index") == {}
    land(landing, "1.json", ("a", "l1\nl2\nl3", "added", None, "c1"), ("b", "x", "added", None, "c1"), ("old", "y", "added", None, "c1"))
    run()
    assert chunks(spark, tmp_path / "index") == {("a", "l1\nl2"): "c1", ("a", "l3"): "c1", ("b", "x"): "c1", ("old", "y"): "c1"}
    land(landing, "2.json", ("a", "l1\nl2\nl4", "modified", None, "c2"), ("b", None, "removed", None, "c2"), ("new", "y", "renamed", "old", "c2"))
    run()
    assert chunks(spark, tmp_path / "index") == {("a", "l1\nl2"): "c2", ("a", "l4"): "c2", ("new", "y"): "c2"}
    run()  # nothing new: no new batch
    assert sync.index(str(tmp_path / "index")).last(spark) == 1


def test_the_last_change_in_the_feed_counts(spark, tmp_path):
    """Commit hashes say nothing about order: b1 comes after f0."""
    landing = tmp_path / "in"
    landing.mkdir()
    land(landing, "1.json", ("a", "old", "added", None, "f0"), ("a", "new", "modified", None, "b1"))
    sync.start_sync(spark, str(landing), str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    assert chunks(spark, tmp_path / "index") == {("a", "new"): "b1"}


FIRST = [("A", "a\na2", "added", None, "c1"), ("X", "x", "added", None, "c1")]
RENAMES = [
    ([("B", "a", "renamed", "A", "c2"), ("B", "b", "modified", None, "c2")], {"B": "b", "X": "x"}),
    ([("B", "a", "renamed", "A", "c2"), ("B", None, "removed", None, "c2")], {"X": "x"}),
    ([("B", "a", "renamed", "A", "c2"), ("C", "a", "renamed", "B", "c2")], {"C": "a", "X": "x"}),
    ([("B", "a", "renamed", "A", "c2"), ("A", "back", "added", None, "c2")], {"A": "back", "B": "a", "X": "x"}),
    ([("A", "new", "modified", None, "c2"), ("B", "new", "renamed", "A", "c2"), ("A", "new", "renamed", "B", "c2")], {"A": "new", "X": "x"}),
    ([("X", "swap", "renamed", "A", "c2"), ("A", "swap2", "renamed", "X", "c2")], {"A": "swap2"}),
    ([("A", "same", "renamed", "A", "c2")], {"A": "same", "X": "x"}),
    ([(None, "lost", "added", None, "c2"), ("B", "b", "renamed", None, "c2")], {"A": "a\na2", "B": "b", "X": "x"}),
]


@pytest.mark.parametrize(("changes", "want"), RENAMES)
def test_renames_within_a_batch(spark, changes, want):
    schema = ", ".join(f"{c} string" for c in CHANGE)
    first = sync.indexed(spark.createDataFrame([], sync.INDEX), spark.createDataFrame(FIRST, schema).coalesce(1))
    got = sync.indexed(first, spark.createDataFrame(changes, schema).coalesce(1)).collect()
    assert {r["path"]: r["content"] for r in got} == want and len(got) == len(want)


def folders(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).glob("*/batch=*/bucket=*"))


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    root, schema = str(tmp_path / "index"), ", ".join(f"{c} string" for c in CHANGE)
    table = sync.index(root, 16)
    batch = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1)
    assert sync.apply_batch(table, batch(*[(f"f{i}", f"text {i}", "added", None, "c0") for i in range(100)]), 0)
    assert len(folders(root)) == 16
    before, one = chunks(spark, root, 16), batch(("f7", "other", "modified", None, "c1"))
    files = {f: os.stat(Path(root, f)).st_mtime_ns for f in folders(root)}
    assert sync.apply_batch(table, one, 1)
    new = set(folders(root)) - set(files)
    assert len(new) == 1 and {f: os.stat(Path(root, f)).st_mtime_ns for f in files} == files  # one bucket written, no other folder changed
    after = chunks(spark, root, 16)
    assert after == {k: v for k, v in before.items() if k[0] != "f7"} | {("f7", "other"): "c1"}
    scanned = table.read(spark, "chunks", only={3}).inputFiles()
    assert scanned and all("/bucket=3/" in f for f in scanned)
    # A replay of a published batch does nothing; one that had failed before its marker writes the same folder again.
    assert not sync.apply_batch(table, one, 1) and chunks(spark, root, 16) == after
    (tmp_path / "index" / "_published" / "1" / "_SUCCESS").unlink()
    assert chunks(spark, root, 16) == before
    assert sync.apply_batch(table, one, 1) and chunks(spark, root, 16) == after and set(folders(root)) == set(files) | new
    # A bucket that loses all its rows is empty, and old folders can go.
    assert sync.apply_batch(table, batch(*[(f"f{i}", None, "removed", None, "c2") for i in range(100)]), 2) and chunks(spark, root, 16) == {}
    assert table.vacuum(spark) == 17 and chunks(spark, root, 16) == {} and folders(root) == []


def test_tables_appear_together_or_not_at_all(spark, tmp_path):
    """A failure between two tables leaves nothing to be seen, and the batch can run again."""
    reviews = Published(str(tmp_path / "r"), {"reviews": ("id long, pr long, latest boolean", "pr"), "findings": ("id long, review_id long", "review_id"), "audit": ("review_id long, what string", "review_id")}, 4)

    def commit(number, fail=False):
        new = spark.createDataFrame([(number, 7, True)], "id long, pr long, latest boolean")
        found = spark.createDataFrame([(10 * number, number), (10 * number + 1, number)], "id long, review_id long")

        def audit(current):
            if fail:
                raise RuntimeError("lost")
            return current.unionByName(spark.createDataFrame([(number, "created"), (number, "published")], "review_id long, what string"))

        demoted = lambda current: current.selectExpr("id", "pr", "latest and pr <> 7 as latest").unionByName(new)
        return reviews.publish(spark, number, {"reviews": (new, demoted), "findings": (found, lambda c: c.unionByName(found)), "audit": (found, audit)})

    seen = lambda: tuple(sorted(map(tuple, reviews.read(spark, t).collect())) for t in reviews.tables)
    with pytest.raises(RuntimeError, match="lost"):
        commit(1, fail=True)
    assert seen() == ([], [], [])
    assert commit(1) and not commit(1)
    first = seen()
    assert first == ([(1, 7, True)], [(10, 1), (11, 1)], [(1, "created"), (1, "published")])
    with pytest.raises(RuntimeError, match="lost"):
        commit(2, fail=True)
    assert seen() == first
    assert commit(2) and seen()[0] == [(1, 7, False), (2, 7, True)] and len(seen()[2]) == 4


def event(kind, who, sequence, mail="m@x", name="N"):
    data = {"id": who, "first_name": name, "last_name": "", "email_addresses": [{"id": "1", "email_address": mail}], "primary_email_address_id": "1"}
    return {"type": f"user.{kind}", "data": data, "sequence": sequence}


def test_shuffled_identity_feed_gives_the_ordered_one(spark, tmp_path):
    rng = random.Random(4)
    feed = [event(rng.choice(["created", "updated", "updated", "deleted"]), f"u{rng.randrange(12)}", s, f"m{s}@x", f"N{s}") for s in range(90)]
    want = {}
    for e in feed:
        want[e["data"]["id"]] = None if e["type"] == "user.deleted" else (e["sequence"], f"m{e['sequence']}@x", f"N{e['sequence']}")
    want = {k: v for k, v in want.items() if v}
    feed += rng.sample(feed, 20) + [event("other", "u1", 1000), event("updated", None, 1001), event("updated", "u2", None)]  # repeated deliveries, rows that say nothing
    rng.shuffle(feed)
    landing = tmp_path / "in"
    landing.mkdir()
    for k in range(4):  # four batches, deletions long before the updates that they outlive
        (landing / f"{k}.json").write_text("".join(json.dumps(e) + "\n" for e in feed[k::4]))
        identity.start_users(spark, str(landing), str(tmp_path / "users"), str(tmp_path / "state"), 4).awaitTermination()
    got = {r["external_id"]: (r["sequence"], r["email"], r["name"]) for r in identity.user_table(str(tmp_path / "users"), 4).read(spark, "users").collect()}
    assert got == want and 0 < len(want) < 12


def test_a_late_update_does_not_bring_a_user_back(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    root = str(tmp_path / "users")
    states = []
    for k, e in enumerate([event("created", "u", 1), event("deleted", "u", 5), event("updated", "u", 3), event("updated", "u", 6, "new@x")]):
        (landing / f"{k}.json").write_text(json.dumps(e) + "\n")
        identity.start_users(spark, str(landing), root, str(tmp_path / "state"), 4).awaitTermination()
        states.append([r["email"] for r in identity.user_table(root, 4).read(spark, "users").collect()])
    assert states == [["m@x"], [], [], ["new@x"]]


SENT = [{"type": "sessionId", "data": 7}, {"type": "sources", "data": [{"path": "é.ts", "n": 1}]}, {"type": "metadata", "data": {"k": None}}, {"type": "text", "data": "data: x\n\ny\r\n"}, {"type": "text", "data": "ü€😀"}, {"type": "text", "data": ""}]
SAID = [("sessionId", "7"), ("sources", '[{"path":"é.ts","n":1}]'), ("metadata", '{"k":null}'), ("text", "data: x\n\ny\r\n"), ("text", "ü€😀"), ("text", "")]


@pytest.mark.parametrize("end", [b"\n\n", b"\r\n\r\n"])
def test_every_cut_of_a_stream_gives_the_same_frames(end):
    body = b": hello" + end + end.join(b"data: " + json.dumps(f, ensure_ascii=False).encode() for f in SENT)
    for size in [*range(1, 40), len(body)]:
        rest, found = b"", []
        for i in range(0, len(body), size):
            whole, rest = frames.cut(rest + body[i : i + size])
            found += whole
        assert [f for raw in [*found, rest] if (f := frames.frame(raw))] == SAID
    for i in range(len(body)):
        first, rest = frames.cut(body[:i])
        second, rest = frames.cut(rest + body[i:])
        assert [f for raw in [*first, *second, rest] if (f := frames.frame(raw))] == SAID


def test_frames_that_cannot_be_read():
    assert frames.frame(b"data: {oops") == ("malformed", "{oops") and frames.frame(b'data: {"type": "other", "data": 1}')[0] == "malformed"
    assert frames.frame(b'data: {"type": "text",\ndata: "data": "x"}') == ("text", "x") and frames.frame(b"event: x") is None and frames.frame(b"") is None


def test_frames_over_batches_and_out_of_order(spark, tmp_path):
    body = b"\n\n".join(b"data: " + json.dumps(f, ensure_ascii=False).encode() for f in SENT)
    parts = [body[i : i + 9] for i in range(0, len(body), 9)]
    reads = [(s, i, bytearray(p), i + 1 == len(parts)) for s in ("one", "two") for i, p in enumerate(parts)]
    random.Random(1).shuffle(reads)
    reads += [reads[0], (None, 0, bytearray(b"x"), True), ("three", 0, None, True)]
    said = lambda rows: {s: [(r["kind"], r["data"]) for r in sorted(rows, key=lambda r: r["position"]) if r["session"] == s] for s in ("one", "two")}
    table = spark.createDataFrame(reads, frames.READS)
    assert said(frames.frames(table).collect()) == {"one": SAID, "two": SAID}
    for k in range(3):
        table.filter(f"pmod(read, 3) = {2 - k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = frames.frames(spark.readStream.schema(frames.READS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    with keyed_state(spark):
        query = stream.writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert said(got) == {"one": SAID, "two": SAID} and len(got) == 12


def push(repo, after, ref="refs/heads/main"):
    return {"ref": ref, "after": after, "repository": {"id": repo, "default_branch": "main"}}


def register(repo):
    return {"registered": True, "repository": {"id": repo, "default_branch": "main"}}


def outcome(repo, commit, ok):
    return {"run": {"repo_id": repo, "commit_sha": commit, "ok": ok}}


def test_pushes_start_runs_and_none_is_lost(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    root = str(tmp_path / "control")

    def after(name, *events):
        (landing / f"{name}.json").write_text("".join(json.dumps(e) + "\n" for e in events))
        pushes.start_pushes(spark, str(landing), root, str(tmp_path / "state"), 4).awaitTermination()
        return {r["repo_id"]: (r["status"], r["indexed"], r["head"], r["running"], r["action"]) for r in pushes.control(root, 4).read(spark, "repositories").collect()}

    assert after("1", register(1), register(2), register(2), push(2, "x", "refs/heads/side"), push(9, "a"), push(None, "b")) == {1: ("NEW", None, None, None, None), 2: ("NEW", None, None, None, None)}
    assert after("2", push(1, "a"), push(1, "b"))[1] == ("INDEXING", None, "b", "b", "initial")
    assert after("3", push(1, "c"))[1] == ("INDEXING", None, "c", "b", "already_indexing")  # the guard keeps the push
    assert after("4", outcome(1, "a", True), outcome(9, "a", True))[1][:4] == ("INDEXING", None, "c", "b")  # of another run, of an unknown repository
    assert after("5", outcome(1, "b", True))[1] == ("INDEXING", "b", "c", "c", "delta")  # the kept push runs next
    assert [tuple(r) for r in pushes.due(pushes.control(root, 4), spark).collect()] == [(1, "c", "b")]
    assert after("6", outcome(1, "c", None))[1] == ("FAILED", "b", "c", None, "finished")  # the pointer stays
    assert after("7", push(1, "c"))[1] == ("INDEXING", "b", "c", "c", "delta")
    assert after("8", outcome(1, "c", False), outcome(1, "c", True))[1] == ("INDEXED", "c", "c", None, "finished")
    assert after("9", push(1, "c"), register(1))[1] == ("INDEXED", "c", "c", None, "up_to_date")
    last = pushes.control(root, 4).last(spark)
    pushes.start_pushes(spark, str(landing), root, str(tmp_path / "state"), 4).awaitTermination()  # nothing new
    assert pushes.control(root, 4).last(spark) == last
    batch = spark.createDataFrame([], pushes.FEED)
    assert not pushes.apply_feed(pushes.control(root, 4), batch, last) and pushes.apply_feed(pushes.control(root, 4), batch, last + 1)
    assert pushes.control(root, 4).read(spark, "repositories").count() == 2
