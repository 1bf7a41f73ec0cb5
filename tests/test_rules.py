"""Hand-worked cases of the rules."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import age, denied, extension, module_name, severity_rank
from tessera.operators import budget, chunking, constraints, delta, markdown, scanning, search, structure, summaries
from tessera.operators import sessions as ops
from tessera.sources import contents, landed, paged, providers


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("lines", "want"), [(200, [(1, 200)]), (201, [(1, 200), (191, 201)]), (380, [(1, 200), (191, 380)]), (381, [(1, 200), (191, 381)]), (390, [(1, 200), (191, 390)]), (391, [(1, 200), (191, 390), (381, 391)])])
def test_line_windows(spark, lines, want):
    text = "\n".join(map(str, range(1, lines + 1)))
    out = chunking.line_windows(spark.createDataFrame([(1, text), (2, None)], "id int, text string")).orderBy("part").collect()
    assert [(r["first_line"], r["last_line"]) for r in out] == want
    assert {r["parts"] for r in out} == {len(want)}
    assert out[-1]["content"].split("\n")[-1] == str(lines)


def test_module_names(spark):
    cases = {
        "src/utils/date.ts": "Utilities", "src/services/config/x.ts": "Configuration", "lib/services/a.ts": "Utilities", "src/services/auth.service.ts": "Auth",
        "src/controllers/user-profile.controller.ts": "User Profile", "src/routes/health.routes.ts": "Health.Routes", "src/modules/chat/chat.types.ts": "Chat",
        "src/main.ts": "Root", "index.ts": "Root", "App/Auth_flow/x.py": "Auth Flow",
    }
    df = spark.createDataFrame(list(cases.items()), "path string, want string").withColumn("got", module_name(F.col("path")))
    assert [(r["path"], r["got"]) for r in df.collect()] == list(cases.items())


def test_extension(spark):
    df = spark.createDataFrame([("a/B.TS",), (".env",), ("x/.env",), ("noext",), ("a.b/c",)], "p string").select(extension(F.col("p")).alias("e"))
    assert [r["e"] for r in df.collect()] == [".ts", "", "", "", ""]


def test_import_resolution(spark):
    paths = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("src/c/index.ts",), ("src/d.tsx",)], "path string")
    said = spark.createDataFrame([("src/a.ts", s) for s in ("./b", "./c", "./d", "../src/b", "./b.js", "react")], "path string, specifier string")
    assert values(structure.import_edges(said, paths), "src", "dst") == [("src/a.ts", "src/b.ts"), ("src/a.ts", "src/c/index.ts"), ("src/a.ts", "src/d.tsx")]


def test_density_merge(spark):
    modules = [(f"{m}{i}", m) for m, n in (("a", 2), ("b", 2), ("c", 1), ("d", 4), ("e", 2)) for i in range(n)]
    counts = [("a", "B", 2), ("a", "C", 1), ("b", "B", 3), ("b", "C", 2), ("c", "B", 1), ("d", "B", 9), ("e", "B", 1), ("e", "C", 1)]
    out = structure.merges(spark.createDataFrame(counts, "module string, target string, edges long"), spark.createDataFrame(modules, "path string, module string"))
    assert values(out, "module", "merged_into") == [("a", "B")]


def test_hash_tree(spark):
    leaves = [hashlib.sha256(x).hexdigest() for x in (b"a", b"b")]
    for rows in (leaves, leaves[::-1]):
        out = structure.parent_hashes(spark.createDataFrame([("p", h) for h in rows], "p string, h string"), "p", "h").first()
        assert out["hash"] == "2017fd492d42a9c6abf497696abced79bc2b001b84c4a6591a1320293c2481d1"


@pytest.mark.parametrize(
    ("stored", "new", "want"),
    [("123", "234", {"1": "delete", "2": "touch", "3": "touch", "4": "insert"}), ("", "1", {"1": "insert"}), ("1", "", {"1": "delete"}), ("1", "11", {"1": "touch"}), ("", "11", {"1": "insert"})],
)
def test_delta(spark, stored, new, want):
    table = lambda x: spark.createDataFrame([("f", h, "c") for h in x], "path string, hash string, commit string")
    assert {r["hash"]: r["action"] for r in delta.diff(table(stored), table(new), ["path", "hash"]).collect()} == want
    after = delta.apply_diff(table(stored), table(new), ["path", "hash"], {"commit": "d"})
    assert values(after, "hash", "commit") == [(h, "d") for h in sorted(set(new))]
    again = delta.diff(after, table(new), ["path", "hash"])
    assert {r["action"] for r in again.collect()} <= {"touch"}


def test_ages(spark):
    cases = {59: "59 seconds ago", 60: "1 minutes ago", 3599: "59 minutes ago", 3600: "1 hours ago", 86399: "23 hours ago", 86400: "Yesterday", 172799: "Yesterday", 172800: "2 days ago"}
    df = spark.createDataFrame([(s,) for s in cases], "s long").withColumn("then", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("s")))
    assert [r["a"] for r in df.select(age(F.col("then"), F.timestamp_seconds(F.lit(1_700_000_000))).alias("a")).collect()] == list(cases.values())


def test_deny_list(spark):
    gone = ["package-lock.json", "web/yarn.lock", "dist/a.js", "a.min.css", "logo.PNG"]
    kept = ["src/dist/a.js", "a.min.ts", "package.json"]
    df = spark.createDataFrame([(p,) for p in gone + kept], "p string").filter(~denied(F.col("p")))
    assert [r["p"] for r in df.collect()] == kept


def test_severity(spark):
    df = spark.createDataFrame([(s,) for s in ("Critical", "Major", "Minor", "critical", None)], "s string").select(severity_rank(F.col("s")).alias("r"))
    assert [r["r"] for r in df.collect()] == [1, 2, 3, 4, 4]


def test_search_edges(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "b", [0.6, 0.8]), (4, "b", None)], "id int, part string, embedding array<double>")
    top = search.top_k(rows, [1.0, 0.0], 5, 0.6, "id")
    assert values(top, "id", "similarity") == [(1, 1.0), (3, 0.6)]  # at the threshold: kept; zero and null vectors: out
    assert search.top_k(rows, [1.0, 0.0], 0, None, "id").count() == 0
    assert search.restricted(rows, "id", []).count() == 4
    assert search.looked_up(rows, "id", []).count() == 0
    assert {r["fallback"] for r in search.hierarchical(rows, [-1.0, 0.0], "id", "part", search.Limits()).collect()} == {True}


def test_summary_tree(spark):
    files = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("c", "y", "3")], "path string, module string, hash string")
    nodes = summaries.wanted_nodes(files)
    stored = nodes.withColumn("summary", F.lit("old"))
    assert summaries.stale_nodes(stored, nodes).count() == 0
    later = summaries.wanted_nodes(files.filter("module = 'x'").withColumn("hash", F.when(F.col("path") == "b", "9").otherwise(F.col("hash"))))
    stale = summaries.stale_nodes(stored, later)
    assert values(stale, "node_type", "node_key") == [("architecture", "architecture"), ("component", "x"), ("file", "b"), ("repository", "repository")]
    after = summaries.refreshed(stored, later, stale.withColumn("summary", F.lit("new")))
    assert values(after, "node_key", "summary") == [("a", "old"), ("architecture", "new"), ("b", "new"), ("repository", "new"), ("x", "new")]


def test_python_chunks(spark):
    source = "import os\n\n# greets\n@dec\ndef f(x):\n    'doc'\n    return x\n\nclass _C:\n    def m(self):\n        pass\n"
    files = spark.createDataFrame([("a/b.py", source), ("bad.py", "def ("), ("x.go", "package x"), ("y.txt", "z"), ("e.py", "")], "path string, content string")
    out = {(r["file_path"], r["qualified_name"]): r for r in chunking.symbol_chunks(files).collect()}
    assert set(out) == {("a/b.py", "f"), ("a/b.py", "_C"), ("a/b.py", "m"), ("bad.py", "bad.py"), ("x.go", "x.go")}
    f = out["a/b.py", "f"]
    assert (f["start_line"], f["end_line"], f["docstring"], f["is_exported"], f["symbol_type"]) == (3, 7, "doc", False, "function")
    assert out["a/b.py", "m"]["parent_symbol"] is None
    assert f["content_hash"] == hashlib.sha256(f["content"].encode()).hexdigest()


def test_landed_feeds(spark, tmp_path):
    (tmp_path / "u.json").write_text(
        '{"type":"user.created","data":{"id":"1","first_name":"A","last_name":"","email_addresses":[{"id":"x","email_address":"x@e"},{"id":"y","email_address":"y@e"}],"primary_email_address_id":"y"}}\n'
        '{"type":"user.deleted","data":{"id":"2"}}\n'
    )
    changes = landed.users(landed.read(spark, str(tmp_path / "u.json"), landed.IDENTITY).withColumn("sequence", F.lit(1)), "sequence")
    assert values(changes, "external_id", "deleted", "email", "name") == [("1", False, "y@e", "A"), ("2", True, None, None)]
    (tmp_path / "p.json").write_text('{"number":3,"title":"t","draft":true,"state":"open","user":{"login":"u"},"head":{"sha":"s"},"updated_at":"2024-01-01T00:00:00Z","files":[{"filename":"a","status":"added","additions":1,"deletions":0}]}\n')
    pulls = landed.read(spark, str(tmp_path / "p.json"), landed.PULL_DETAIL)
    assert values(landed.pulls(pulls), "number", "author", "status") == [(3, "u", "draft")]
    assert values(landed.pull_files(pulls), "filename", "patch") == [("a", "")]
    blobs = spark.createDataFrame([("a.ts", "blob", "x"), ("dist/b", "blob", "x"), ("d", "tree", "x"), ("e", "blob", "")], "path string, type string, content string")
    assert values(landed.tree(blobs), "path") == [("a.ts",)]
    repos = spark.createDataFrame([], landed.REPOSITORY)
    assert len(landed.repositories(repos).columns) == 11


def model():
    """A model that needs no network: the length of each text, and the first words of a prompt. Its class goes along by value."""

    class Words:
        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

        def generate(self, prompt):
            return " ".join(prompt.split()[:12])

    return Words()


def test_providers(spark):
    rows = spark.createDataFrame([("a b",), ("",), (None,), ('{"strengths": ["x"], "weaknesses": [], "overallAssessment": "y", "score": 2}',)], "text string")
    assert [r["embedding"] for r in providers.embedded(rows, "text", model()).collect()][:3] == [[3.0, 1.0], [0.0, 1.0], [0.0, 1.0]]
    assert rows.select(providers.generated(F.col("text"), model()).alias("g")).first()["g"] == "a b"
    read = rows.select(providers.structured(F.col("text"), model(), "final_assessment").alias("x")).select("x.score", "x.strengths").collect()
    assert tuple(read[3]) == (2.0, ["x"]) and [r["score"] for r in read[:3]] == [None] * 3


def test_summary_store(spark, tmp_path):
    asked = []

    def write(stale):
        asked.append(sorted(r["node_key"] for r in stale.collect()))
        return stale.withColumn("summary", F.concat(F.lit("about "), "node_key", F.lit(" "), F.substring("content_hash", 1, 4)))

    store = summaries.SummaryStore(str(tmp_path), 4)
    pipeline = summaries.SummaryPipeline(store, write, refine=lambda f: f.withColumn("module", F.when(F.col("module") == "tiny", "x").otherwise(F.col("module"))))
    files = lambda *rows: spark.createDataFrame(rows, "path string, module string, hash string")
    assert pipeline.run(0, files(("a", "x", "1"), ("b", "tiny", "2"), ("c", "y", "3")))
    assert asked[-1] == ["a", "architecture", "b", "c", "repository", "x", "y"]
    assert not pipeline.run(0, files(("a", "x", "9")))  # a run that was published changes nothing
    assert pipeline.run(1, files(("a", "x", "1"), ("b", "x", "5")))
    assert asked[-1] == ["architecture", "b", "repository", "x"]
    assert values(store.nodes(spark, "file"), "node_key", "summary") == [("a", "about a 1"), ("b", "about b 5")]
    assert store.nodes(spark, key="x").count() == 1 and store.nodes(spark, key="y").count() == 0 and store.nodes(spark).count() == 5


def test_sessions(spark):
    sessions = spark.createDataFrame([("s1", "ISSUE_CHAT", 1, 10), ("s0", "ISSUE_CHAT", 1, 10), ("s2", "QA", 1, 11)], "session_id string, kind string, user_id int, finding_id int")
    requests = [(1, "ISSUE_CHAT", 1, 10), (2, "ISSUE_CHAT", 2, 10), (3, "ISSUE_CHAT", 2, 10), (4, "ISSUE_CHAT", 1, None), (5, "QA", 1, 11), (6, None, 1, 10), (7, "ISSUE_CHAT", None, 10)]
    got = values(ops.found_or_made(sessions, spark.createDataFrame(requests, "request_id int, kind string, user_id int, finding_id int")), "request_id", "session_id", "made")
    assert got == [(1, "s0", False), (2, "2", True), (3, "2", False), (4, "4", True), (5, "5", True), (6, "6", True), (7, "7", True)]
    open_ = spark.createDataFrame([("a", 1, "active"), ("b", 2, "active"), ("c", None, "active")], "session_id string, user_id int, status string")
    assert values(ops.ended(open_, spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", None)], "session_id string, user_id int")), "session_id", "status") == [("a", "completed"), ("b", "active"), ("c", "active")]


def test_contexts_by_kind(spark):
    findings = spark.createDataFrame([(1, 5, "Minor", "b.ts", 3, "m"), (2, 5, "Critical", "z.ts", 9, "c"), (3, 5, "Minor", "a.ts", None, "n"), (4, 5, None, "q.ts", 1, "i")], "finding_id int, review_id int, severity string, path string, line int, title string")
    chunks = spark.createDataFrame([(8, 2, "two"), (8, 1, "one")], "repository_id int, position int, path string")
    rows = [("r", "REVIEW", 5, None, None), ("e", "REVIEW_CHAT", 6, None, None), ("i", "ISSUE_CHAT", None, 3, None), ("q", "QA", None, None, 8), ("u", "OTHER", None, None, 8), ("n", None, None, None, 9)]
    sessions = spark.createDataFrame(rows, "session_id string, kind string, review_id int, finding_id int, repository_id int")
    builders = {"REVIEW_CHAT": lambda s: ops.review_context(s, findings.drop("finding_id"), 3), "ISSUE_CHAT": lambda s: ops.issue_context(s, findings), "REPO_QA": lambda s: ops.repository_context(s, chunks)}
    assert values(ops.contexts(sessions, builders), "session_id", "kind", "context", "sources") == [
        ("e", "REVIEW_CHAT", "", 0), ("i", "ISSUE_CHAT", "MINOR a.ts:N/A n", 1), ("n", "REPO_QA", "", 0), ("q", "REPO_QA", "[1] one\n[2] two", 2),
        ("r", "REVIEW_CHAT", "CRITICAL z.ts:9 c\nMINOR a.ts n\nMINOR b.ts:3 m", 4), ("u", "REPO_QA", "[1] one\n[2] two", 2),
    ]


def test_long_chunks_are_split(spark):
    source = "x = 1\nclass C:\n" + "\n".join(f"    a{i} = {i}" for i in range(385)) + "\n\ndef f():\n    pass\n"
    files = spark.createDataFrame([("a.py", source), ("b.ts", "\n".join(map(str, range(300))))], "path string, content string")
    out = sorted(chunking.split_large(chunking.symbol_chunks(files)).collect(), key=lambda r: (r["file_path"], r["start_line"]))
    assert [(r["symbol_name"], r["start_line"], r["end_line"], r["chunk_index"], r["chunk_total"]) for r in out] == [
        ("C (part 1/2)", 2, 197, 1, 2), ("C (part 2/2)", 188, 387, 2, 2), ("f", 389, 390, None, None), ("b.ts (part 1/2)", 1, 198, 1, 2), ("b.ts (part 2/2)", 189, 300, 2, 2)
    ]
    lines = source.split("\n")
    assert out[1]["content"].split("\n") == lines[187:387] and out[0]["content"].split("\n")[4:] == lines[1:197]
    assert all(r["content_hash"] == hashlib.sha256(r["content"].encode()).hexdigest() and r["content"].count("\n") < 200 for r in out)


def test_file_facts(spark):
    source = "import os, a.b as c\nfrom ..d import e\n__all__ = ['C']\n@dec(1)\nclass C(Base, m.Mix):\n    @property\n    def p(self):\n        import os\n"
    files = spark.createDataFrame([("x.py", source), ("bad.py", "def ("), ("y.ts", "import z"), ("n.py", None)], "path string, content string")
    assert {tuple(r) for r in chunking.file_facts(files).collect()} == {
        ("x.py", "import", "os", None), ("x.py", "import", "a.b", None), ("x.py", "import", "..d", "e"), ("x.py", "export", "C", None),
        ("x.py", "decorator", "C", "dec(1)"), ("x.py", "decorator", "p", "property"), ("x.py", "inheritance", "C", "Base"), ("x.py", "inheritance", "C", "m.Mix"),
    }


def test_markdown_blocks_know_fences(spark):
    text = "# A `b`\n\n```py\n# no heading\n- x\n```\n> q **r** *s*\n* i\n2. j\n````\nz```\n```\n````\n```\n- open"
    rows = markdown.block_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("position").collect()
    assert [(r["kind"], r["mark"], r["content"]) for r in rows] == [
        ("heading", "#", "A `b`"), ("fence", "py", "# no heading\n- x"), ("quote", ">", "q **r** *s*"), ("item", "*", "i"), ("numbered", "2", "j"),
        ("fence", "code", "z```\n```"), ("paragraph", None, "```"), ("item", "-", "open"),
    ]
    assert rows[0]["code"] == ["b"] and (rows[2]["bold"], rows[2]["italic"]) == (["r"], ["s"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("*a **b** c*", ([], ["b"], ["a **b** c"])), ("**a *b* c**", ([], ["a *b* c"], ["b"])), ("`*a*` *b*", (["*a*"], [], ["b"])), ("*a", ([], [], [])), ("**", ([], [], [])), ("* *", ([], [], [" "])),
        ("`` x", ([], [], [])), ("`a", ([], [], [])), ("2 * 3 ** 4", ([], [], [])), ("**a** `b` **c**", (["b"], ["a", "c"], [])),
    ],
)
def test_inline_marks(text, want):
    assert markdown.inline_marks(text) == want


def test_constraints(spark):
    rows = [(1, "a", "x", 5), (2, "a", "x", 5), (3, "a", None, 5), (4, "a", None, 5), (5, "b", "x", None), (6, "b", "y", -1), (7, None, "x", 1), (8, "z", "q", -2)]
    df = spark.createDataFrame(rows, "id int, owner string, kind string, n int").withColumn("violated_0", F.lit("mine"))
    known = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "name string")
    rules = [constraints.Unique("one x", ("owner", "kind"), ("id",), "kind = 'x'"), constraints.Check("positive", "n >= 0"), constraints.Required("owned", "owner"), constraints.Reference("owner known", "owner", known, "name")]
    got = {r["id"]: r["broken"] for r in constraints.checked(df, rules, "broken").collect()}
    assert got == {1: [], 2: ["one x"], 3: [], 4: [], 5: [], 6: ["positive"], 7: ["owned"], 8: ["positive", "owner known"]}
    good, bad = constraints.quarantined(df, rules, "broken")
    assert values(good, "id") == [(1,), (3,), (4,), (5,)] and bad.count() == 4 and good.columns == df.columns
    assert constraints.violations(df.limit(0), rules, "broken").count() == 0 and constraints.checked(df, [], "broken").filter("size(broken) = 0").count() == 8


def test_running_sums_by_blocks(spark):
    rows = [("hot", i, i % 7) for i in range(3000)] + [("b", 10_000_000, 3), ("b", -5, None), ("b", 2, 4), (None, 1, 1), ("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r["g"], r["o"]): r["s"] for r in budget.running_before(df, "g", "o", "v", "s", block=64).collect()}
    want, total = {("b", -5): 0, ("b", 2): 0, ("b", 10_000_000): 4}, 0
    for i in range(3000):
        want["hot", i] = total
        total += i % 7
    assert got == want
    cut = budget.running_before(df, "g", "o", "v", "s", block=64, budget=100)
    assert {(r["g"], r["o"]): r["s"] for r in cut.collect()} == {k: v for k, v in want.items() if v < 100}


def test_batch_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "mine", rng.standard_normal(3).tolist()) for i in range(60)] + [(60, "mine", [0.0, 0.0, 0.0]), (61, "mine", None), (None, "mine", [1.0, 0.0, 0.0]), (62, "mine", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, rank string, embedding array<double>").repartition(4)
    for travelling in (search.TRAVELLING, 5):
        search.TRAVELLING, before = travelling, search.TRAVELLING
        out = search.top_k_each(df, df.filter("id % 6 = 0 or id > 59"), 4, "id", names=("asked", "place", "score")).collect()
        search.TRAVELLING = before
        assert {r["rank"] for r in out} == {"mine"}
        unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if i is not None and i < 60}
        for q in range(0, 60, 6):
            want = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in unit if i != q)[:4]
            got = sorted((r["place"], r["id"], r["score"]) for r in out if r["asked"] == q)
            assert [i for _, i, _ in got] == [i for _, i in want] and [s for *_, s in got] == pytest.approx([-s for s, _ in want], abs=2e-6)
        assert {r["asked"] for r in out} == set(range(0, 60, 6))


def test_pages_are_read_as_filters_and_limits_ask(spark, tmp_path):
    """The filter is the listing's work, pages beyond a limit are not fetched."""
    folder = str(tmp_path)

    def fetch(number, wanted):
        with open(f"{folder}/{number}", "a") as f:  # noqa: PTH123
            f.write(json.dumps(wanted) + "\n")
        rows = [{"number": 10 * number + i, "state": "open" if i % 2 else "closed", "title": None if i == 3 else f"t{i}"} for i in range(10)]
        return [r for r in rows if all(r[c] == v for c, v in wanted.items())]

    listing = lambda name, **kw: paged.read_pages(spark, fetch, "number int, state string, title string", 5, name=name, per_page=10, **kw)
    opened = listing("pulls", handed={"state"}).filter("state = 'open' and number > 20")
    assert values(opened, "number", "title") == [(10 * p + i, None if i == 3 else f"t{i}") for p in range(2, 6) for i in (1, 3, 5, 7, 9)]
    assert "state" not in opened._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0] or "= open" not in opened._jdf.queryExecution().executedPlan().toString()
    assert {json.loads(x)["state"] for p in range(1, 6) for x in (tmp_path / str(p)).read_text().splitlines()} == {"open"}
    for p in range(1, 6):
        (tmp_path / str(p)).unlink()
    assert listing("first", limit=14).count() == 14
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1", "2"]


def test_raw_contents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text").collect()
    for r in docs:
        (tmp_path / "tree" / r["source"] / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / r["source"] / "deep" / f"{r['doc_id']}.{'md' if r['doc_id'] % 3 else 'bin'}").write_text(r["text"], newline="")
    files = contents.files_below(spark, str(tmp_path / "tree"), "*.md")
    wanted = spark.createDataFrame([(f"{r['source']}/deep/{r['doc_id']}.md", r["doc_id"]) for r in docs] + [(None, -1)], "path string, doc_id long")
    got = {r["doc_id"]: r["content"] for r in contents.contents_of(wanted, files).collect()}
    assert got == {r["doc_id"]: r["text"] if r["doc_id"] % 3 else None for r in docs} | {-1: None}
    assert contents.files_below(spark, str(tmp_path / "tree")).count() == len(docs)


def test_module_file_lists_counts_without_lists(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "en"), (None, "a", "en"), (3, "a", "de"), (4, "b", "de")], "doc_id long, source string, lang string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    from tessera.plans import catalogue

    out = catalogue.QUERIES["module_file_lists"](spark, str(tmp_path))
    assert values(out, "source", "files", "languages", "english") == [("a", 3, "de,en", 2), ("b", 1, "de", 0)]
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_scanned_symbols():
    source = "/** says { */\nexport const say = async (x: string): Promise<void> => {\n  call('}');\n};\nexport interface P { a: number }\ntype T =\n  | 'a'\n  | 'b';\nexport default class K {\n  // runs\n  @log\n  run(a: number) {\n    if (a) { return; }\n  }\n  field = (x) => x;\n}\nenum E { A }\n"
    got = {(kind, name): rest for kind, name, *rest in scanning.symbols("TypeScript", source)}
    assert got["function", "say"] == [None, True, "/** says { */", 0, 3]
    assert got["interface", "P"][1:] == [True, None, 4, 4] and got["type", "T"][3:] == [5, 7]
    assert got["class", "K"] == [None, True, None, 8, 15] and got["method", "run"] == ["K", True, "// runs", 9, 13] and got["method", "field"][3:] == [14, 14]
    assert got["enum", "E"][3:] == [16, 16] and len(got) == 7
    cpp = "#include <x>\nstruct P {\n  int a;\n};\nint add(int a, int b) {\n  return a + b;\n}\nint later(int);\n"
    assert [(k, n, a, b) for k, n, *_, a, b in scanning.symbols("C++", cpp)] == [("class", "P", 1, 3), ("function", "add", 4, 6)]
    go = "package a\ntype R struct {\n\tx int\n}\nfunc New() *R {\n\treturn &R{}\n}\n"
    assert [(k, n, a, b) for k, n, *_, a, b in scanning.symbols("Go", go)] == [("class", "R", 1, 3), ("function", "New", 4, 6)]


def test_markdown_rows_are_made_run_by_run(spark):
    """Before, a batch's blocks were all held until its last document was read."""
    texts = ["- a " * 60_000, "", *["# b\n"] * 5, "> é" * 300_000, "1. c"]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": texts})
    runs = list(markdown._runs(batch, 1))
    assert [t for r in runs for t in r.column(1).to_pylist()] == texts and [r.num_rows for r in runs] == [7, 1, 1]
    docs = spark.createDataFrame([(None, "# a\n\n- *b*"), ("x", ""), ("y", None), ("z", "```py\n1\n```\n2. c")], "k string, text string")
    rows = values(markdown.block_rows(docs, "k"), "k", "position", "kind", "mark", "content", "italic")
    assert rows == sorted([(None, 0, "heading", "#", "a", []), (None, 1, "item", "-", "*b*", ["b"]), ("z", 0, "fence", "py", "1", []), ("z", 1, "numbered", "2", "c", [])], key=repr)
    assert markdown.block_rows(docs.filter("k = 'x'"), "k").count() == 0
