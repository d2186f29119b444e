"""A small knowledge base on disk: sources, sinks, commands, views and bundle."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lorequarry import cli
from lorequarry.functions import markdown
from lorequarry.operators import bundle, evals, health, index, pack, publish, retrieve, snapshot
from lorequarry.sources import files, sinks, wiki

PAGES = {
    "alpha.md": "---\ntitle: Alpha page\nprofile: notes\nlang: en\nsources: [raw/a.txt, raw/b.txt]\nconfidence: 0.75\ncontested: true\n---\n# Alpha\n\nThe red fox. See [beta](sub/beta.md#top) and [bad](javascript:x) and [[gamma]].\n\n## Part\n\nx\n\n## Part\n\n| a | b |\n|---|---|\n| 1 | 2 |\n",
    "sub/beta.md": "# Beta\n\nThe fox sleeps at /home/user/secret.txt. [gone](missing.md)\n",
    "gamma.md": "no heading, füchse und red\n",
    "empty.md": "",
    "odd name+plus.md": "# Odd\n\nred red red\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("kb") / "wiki root"
    sinks.init_wiki(top, {"core_direction": "foxes"}, draft=True)
    for name, text in PAGES.items():
        (top / "wiki" / name).parent.mkdir(exist_ok=True)
        (top / "wiki" / name).write_text(text, "utf-8")
    (top / "raw/a.txt").write_bytes(b"raw \xc3\xa9")
    (top / "glossary.json").write_text(json.dumps([{"term": "fox", "lang": "en", "equivalents": [{"term": "Füchse", "lang": "de"}]}]), "utf-8")
    (top / "glossary.jsonl").write_text('{"term": "red", "lang": "en", "equivalents": [{"term": "rot", "lang": "de"}]}\nnot json\n', "utf-8")
    (top / "retrieval-evals.jsonl").write_text('{"eval_id": "e1", "query": "red fox", "expected_page_ids": ["alpha", "nowhere"]}\n{"eval_id": "e2", "query": "zzz", "expected_page_ids": []}\n', "utf-8")
    return str(top)


def test_init_keeps_what_is_there(root):
    assert sinks.init_wiki(root) == []
    c = wiki.contract(root)
    assert c["core_direction"] == "foxes" and c["status"] == "draft" and c["context_pack"]["max_chunks_per_page"] == 8
    assert wiki.profiles(root) == {"general": {"fields": []}}
    assert wiki.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_pages_and_notes(spark, root):
    got = {r["page_id"]: r for r in wiki.pages(spark, root).collect()}
    assert set(got) == {"alpha", "sub/beta", "gamma", "empty", "odd name+plus"}
    a = got["alpha"]
    assert (a["title"], a["profile"], a["lang"], a["sources"], a["confidence"], a["contested"]) == ("Alpha page", "notes", "en", ["raw/a.txt", "raw/b.txt"], 0.75, True)
    assert a["text"].startswith("# Alpha") and got["sub/beta"]["title"] == "Beta" and got["gamma"]["title"] == "gamma" and got["empty"]["text"] == ""
    (note,) = wiki.raw_notes(spark, root).collect()
    assert note["path"] == "a.txt" and note["content"] == "raw é" and len(note["content_sha256"]) == 64


def test_missing_layers_are_empty(spark, tmp_path):
    assert wiki.pages(spark, str(tmp_path)).count() == wiki.glossary(spark, str(tmp_path)).count() == wiki.query_log(spark, str(tmp_path)).count() == 0
    assert wiki.raw_notes(spark, str(tmp_path)).count() == 0 and wiki.profiles(tmp_path) == {}


def test_glossary_goes_both_ways(spark, root):
    pairs = {tuple(r) for r in wiki.glossary(spark, root).collect()}
    assert pairs == {("fox", "en", "füchse", "de"), ("red", "en", "rot", "de")}
    q = spark.createDataFrame([("q", "rot")], "query_id string, text string")
    words = lambda lang: {r["term"] for r in retrieve.expand(retrieve.query_terms(q), wiki.glossary(spark, root), lang).collect()}
    assert words(None) == words("de") == {"rot", "red"} and words("en") == {"rot"}  # "rot" is no English entry


def test_index_round_trip(spark, root):
    pages = wiki.pages(spark, root)
    posts, edges = index.postings(pages), cli.graph(pages)
    sinks.write_index(posts, edges, root)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(wiki.memory_index(spark, root)) == key(posts)
    assert key(wiki.link_graph(spark, root)) == key(edges.select("src", "href", "dst"))
    dst = {(r["src"], r["href"]): (r["dst"], r["safe"]) for r in edges.collect()}
    assert dst["alpha", "sub/beta.md#top"] == ("sub/beta", True) and dst["alpha", "gamma"] == ("gamma", True)
    assert dst["alpha", "javascript:x"] == (None, False) and dst["sub/beta", "missing.md"] == (None, True)


def test_stored_index_ranks_alike(spark, root):
    sinks.write_index(index.postings(wiki.pages(spark, root)), cli.graph(wiki.pages(spark, root)), root)
    a, b = (cli.retrieved(spark, root, "red fox", 10, None, s)[2].collect() for s in (True, False))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a[0]["page_id"] == "alpha"


def test_commands(spark, root, capsys):
    assert cli.main(["validate", root, "--json"]) == 1  # the unsafe link
    found = json.loads(capsys.readouterr().out)
    assert {x["rule"] for x in found} >= {"empty_page", "dangling_link", "unsafe_link", "orphan_page", "missing_source", "short_page"}
    assert cli.main(["retrieve", root, "red fox", "--json"]) == 0
    rows = json.loads(capsys.readouterr().out)
    seeds, context = ({r["page_id"] for r in rows if r["role"] == k} for k in ("seed", "context"))
    assert rows[0]["page_id"] == "alpha" and "gamma" in seeds and not seeds & context
    assert cli.main(["retrieve", root, "sleeps"]) == 0
    log = wiki.query_log(spark, root).orderBy("query").collect()
    assert [(r["query"], r["result_page_ids"][0]) for r in log] == [("red fox", "alpha"), ("sleeps", "sub/beta")]
    capsys.readouterr()
    assert cli.main(["context-pack", root, "red fox", "--max-chars-per-page", "30", "--max-chunks-per-page", "2", "--json", "--write"]) == 0
    chunks = json.loads(capsys.readouterr().out)
    assert chunks[0]["contested"] is True and chunks[0]["sources"] == ["raw/a.txt", "raw/b.txt"] and chunks[0]["reasons"] == ["term:fox", "term:red"]
    assert all(sum(c["kept_chars"] for c in chunks if c["page_id"] == p) <= 30 for p in {c["page_id"] for c in chunks})
    assert len([x for x in os.listdir(f"{root}/reports/context-packs") if x.startswith("pack-")]) == 2
    assert cli.main(["evaluate", root, "--json"]) == 0
    (e,) = json.loads(capsys.readouterr().out)
    assert (e["query_id"], e["expected"], e["found"], e["recall"], e["reciprocal_rank"]) == ("e1", 2, 1, 0.5, 1.0)
    assert cli.main(["health", root, "--json"]) == 0 and cli.main(["build-index", root, "--write"]) == 0


def test_html(spark, root):
    assert cli.main(["publish-html", root, "--clean"]) == 0
    out = f"{root}/reports/publish/html"
    alpha = open(f"{out}/alpha-page.html", encoding="utf-8").read()
    assert 'href="beta.html#top"' in alpha and 'href="gamma.html"' in alpha and "javascript" not in alpha
    assert 'id="part"' in alpha and 'id="part--2"' in alpha and '<thead><tr><th scope="col">a</th>' in alpha and '<meta name="source" content="raw/a.txt,raw/b.txt">' in alpha
    assert len([x for x in os.listdir(out) if x.endswith(".html")]) == len(PAGES)
    open(f"{out}/stale.html", "w").close()
    assert cli.main(["publish-html", root, "--clean"]) == 0 and not os.path.exists(f"{out}/stale.html")


@pytest.mark.parametrize("mode", bundle.MODES)
def test_bundle(spark, root, mode):
    assert cli.main(["publish-mcp", root, "--mode", mode, "--clean", "--name", "Fox Book"]) == 0
    out = f"{root}/reports/publish/mcp"
    read = lambda name: open(f"{out}/{name}", encoding="utf-8").read()
    for name in ("manifest.json", "resources.json", "tools.json", "prompts.json", "quality.json", "server-config.json", "server.py", "requirements.txt", "README.md", "skills/fox-book-wiki/SKILL.md", "skills/fox-book-wiki/agents/openai.yaml", "schemas/manifest.json", "schemas/pages.schema.json"):
        assert read(name), name
    compile(read("server.py"), "server.py", "exec")
    assert json.loads(read("manifest.json"))["pages"] == 5 and not json.loads(read("quality.json"))["ready"] and read("requirements.txt") == "mcp>=1.28,<2\n"
    copies = f"{out}/snapshot/wiki"
    assert os.path.exists(copies) == (mode == "snapshot")
    if mode == "snapshot":
        assert "/home/user" not in open(f"{copies}/sub/beta.md", encoding="utf-8").read()
        assert root not in "".join(read(n) for n in ("manifest.json", "resources.json", "server-config.json"))
    else:
        assert json.loads(read("resources/part-000000.json"))[0]["path"].startswith(root)
    listing = json.loads(read("resources.json"))
    assert listing["parts"] == 1 and len(json.loads(read("resources/part-000000.json"))) == 5
    assert not any(n.startswith(".") for n in os.listdir(out))


def test_strict_bundle_stops(spark, root):
    with pytest.raises(ValueError, match="not ready"):
        cli.main(["publish-mcp", root, "--strict"])


def test_resources_are_split(spark):
    pages = spark.range(5001).select(F.col("id").cast("string").alias("page_id"), F.lit("t").alias("text"))
    got = {r["rel_path"]: json.loads(r["content"]) for r in bundle.resource_files(bundle.resources(pages, "snapshot")).collect()}
    assert got["resources.json"]["parts"] == 3 and sum(len(v) for k, v in got.items() if k != "resources.json") == 5001


def test_confinement(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/link").symlink_to("/etc")
    for bad in ("../x", "/etc/passwd", "a/../../x", "link/passwd", "C:\\x", "", "a\x00"):
        with pytest.raises(files.Outside):
            files.confined(tmp_path / "in", bad)
    assert files.confined(tmp_path / "in", "a/./b.md").name == "b.md"


def test_excluded_names_and_transitive_privacy(spark):
    rows = spark.createDataFrame([("a", "x"), ("raw/b", "x"), ("../c", "x"), ("d", "x"), ("e", "x"), (None, "x")], "page_id string, text string")
    links = spark.createDataFrame([("d", "p"), ("p", "d"), ("e", "d"), ("a", "a")], "src string, dst string")
    private = spark.createDataFrame([("p",)], "page_id string")
    assert [r["page_id"] for r in bundle.published(rows, private, links).collect()] == ["a"]
    assert {r["page_id"] for r in snapshot.reached(private, links).collect()} == {"p", "d", "e"}


def test_names_never_collide(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "A"), (3, "a-2"), (4, "a 2"), (5, "!"), (6, None)], "page_id int, title string")
    names = [r["file_name"] for r in index.file_names(rows).orderBy("page_id").collect()]
    assert names == ["a.html", "a--2.html", "a-2.html", "a-2--2.html", "section.html", "section--2.html"]


def test_sections_match_the_html(spark):
    text = "intro\n# One\nbody é\n## Two ##\n# One\n"
    got = index.sections(spark.createDataFrame([("p", text)], "page_id string, text string")).orderBy("section_no").collect()
    assert [(r["level"], r["heading"], r["anchor"]) for r in got] == [(1, "One", "one"), (2, "Two", "two"), (1, "One", "one--2")]
    assert [text[r["start_off"] : r["end_off"]] for r in got] == ["# One\nbody é\n", "## Two ##\n", "# One\n"]
    html = markdown.body(text)
    assert all(f'id="{r["anchor"]}"' in html for r in got)


def test_budgets(spark):
    pages = spark.createDataFrame([("p", "red " * 300), ("q", "x"), ("r", "")], "page_id string, text string")
    ranked = spark.createDataFrame([("1", "p"), ("1", "q"), ("1", "r")], "query_id string, page_id string")
    terms = spark.createDataFrame([("1", "red")], "query_id string, term string")
    chunks = pack.chunks(pages, 400)
    assert all(r["chunk"] == ("red " * 300)[r["start_off"] : r["end_off"]] for r in chunks.where("page_id = 'p'").collect())
    for limit in (1, 399, 400, 401, 5000):
        kept = pack.within_budget(pack.ranked_chunks(chunks, ranked, terms), limit, 2).collect()
        assert sum(r["kept_chars"] for r in kept if r["page_id"] == "p") == min(limit, 800)
        assert all(len(r["chunk"]) == r["kept_chars"] == r["end_off"] - r["start_off"] for r in kept)
    for bad in ((0, 1), (-1, 1), (1, 0)):
        with pytest.raises(ValueError):
            pack.within_budget(chunks, *bad)


def test_drift_and_stale(spark):
    now = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "page_id string, text string")
    then = now.where("page_id <> 'c'").select("page_id", F.sha2(F.when(F.col("page_id") == "a", "x").otherwise("z"), 256).alias("recorded_hash")).unionByName(spark.createDataFrame([("d", None)], "page_id string, recorded_hash string"))
    assert {r["page_id"]: r["status"] for r in health.stale(then, now).collect()} == {"a": "ok", "b": "changed", "c": "new", "d": "gone"}
    assert [r["page_id"] for r in health.drift(then, now).collect()] == ["b"]


def test_containment_and_metrics(spark):
    pages = spark.createDataFrame([(1, "xx one two three four yy"), (2, "one two")], "page_id int, text string")
    items = spark.createDataFrame([(7, "one two three four"), (8, "not in any page at all")], "query_id int, text string")
    assert [tuple(r) for r in evals.containing(pages, items).collect()] == [(7, 1)]


def test_containment_of_items_without_an_inner_phrase(spark, monkeypatch):
    texts = {"a": "私は東京都に住んでいます", "b": "one two, three", "c": "none of it", "d": "", "e": None, "f": "Alone two threes: 東京"}
    asked = {1: "東京都", 2: "one two", 3: "東京", 4: "lone", 5: ",", 6: "", 7: None, 8: "one two, three", 9: "One", 10: "two three"}
    pages = spark.createDataFrame(list(texts.items()), "page_id string, text string")
    items = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    want = sorted((q, p) for q, x in asked.items() for p, t in texts.items() if x is not None and t is not None and x in t)
    for few, block in ((16, 1000), (0, 1000), (0, 8)):
        monkeypatch.setattr(evals, "FEW", few)
        monkeypatch.setattr(evals, "BLOCK_BYTES", block)
        assert sorted(tuple(r) for r in evals.containing(pages, items).collect()) == want
    assert sorted(tuple(r) for r in evals.containing(pages, items.where("query_id < 4")).collect()) == [x for x in want if x[0] < 4]


def test_rendering_of_empty_and_null_pages(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, "t", "[[1]] & <b>", "en", "s")], "page_id int, title string, text string, lang string, source string")
    got = {r["page_id"]: r["html"] for r in publish.rendered(rows).collect()}
    assert 'lang="und"' in got[1] and "&amp; &lt;b&gt;" in got[2] and 'href="section.html"' in got[2]


def test_query_log_stream(spark, tmp_path):
    from lorequarry.streaming import query_log

    rows = [("q", f"2024-01-01T0{h}:30:00Z", "x", "p", ids) for h, ids in ((0, ["a"]), (0, []), (1, ["a"]), (5, ["a"]))]
    from lorequarry import schemas

    log = spark.createDataFrame(rows, schemas.QUERY_LOG)
    log.coalesce(1).write.json(f"{tmp_path}/query-log.jsonl")
    query_log.follow(query_log.read_log(spark, str(tmp_path)), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    closed = {(str(r["window_start"]), r["queries"], r["empty"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert closed == {("2024-01-01 00:00:00", 2, 1), ("2024-01-01 01:00:00", 1, 0)}
    whole = {(str(r["window_start"]), r["queries"], r["empty"]) for r in query_log.windowed(log.withColumn("ts", F.to_timestamp("ts"))).collect()}
    assert whole == closed | {("2024-01-01 05:00:00", 1, 0)}


def knowledge(top, pages, contract=None, **files_):
    sinks.init_wiki(top, contract)
    for name, text in pages.items():
        (top / "wiki" / name).parent.mkdir(parents=True, exist_ok=True)
        (top / "wiki" / name).write_text(text, "utf-8")
    for name, text in files_.items():
        (top / name.replace("__", "/")).write_text(text, "utf-8")
    return str(top)


def test_links_on_disk_are_not_followed(spark, tmp_path, capsys):
    outside = tmp_path / "outside"
    (outside / "deep").mkdir(parents=True)
    for n in ("secret.md", "deep/more.md", "empty.md"):
        (outside / n).write_text("" if n == "empty.md" else "# Secret", "utf-8")
    root = knowledge(tmp_path / "kb", {"a.md": "# A", "sub/b.md": "# B", "linked-not.md": "# C"})
    (tmp_path / "kb/wiki/link.md").symlink_to(outside / "secret.md")
    (tmp_path / "kb/wiki/none.md").symlink_to(outside / "empty.md")
    (tmp_path / "kb/wiki/folder").symlink_to(outside)
    (tmp_path / "kb/wiki/linked").symlink_to(outside / "deep")
    (tmp_path / "kb/raw/x.txt").symlink_to(outside / "secret.md")
    assert {r["page_id"] for r in wiki.pages(spark, root).collect()} == {"a", "sub/b", "linked-not"}
    assert wiki.raw_notes(spark, root).count() == 0
    assert cli.main(["publish-mcp", root]) == 0
    capsys.readouterr()
    copied = [os.path.join(d, f) for d, _, fs in os.walk(f"{root}/reports/publish/mcp/snapshot") for f in fs]
    assert len(copied) == 3 and not any("Secret" in open(f, encoding="utf-8").read() for f in copied)
    # a root that is itself a link is the user's own choice
    (tmp_path / "way").symlink_to(tmp_path / "kb")
    assert wiki.pages(spark, f"{tmp_path}/way").count() == 3


def test_snapshots_follow_the_contract(spark, tmp_path, capsys):
    pages = {"a.md": "# A", "b.md": "[to c](c.md)", "c.md": "[to d](d.md)", "d.md": "---\nprivate: true\n---\nsecret", "e.md": "[to f](f.md)", "f.md": "named in the contract", "x/g.md": "# G", "x/h.md": "# H"}
    root = knowledge(tmp_path / "kb", pages, {"publish": {"private": ["f"], "allow": ["a", "b", "c", "d", "e", "f", "x/g*"]}})
    assert cli.main(["publish-mcp", root]) == 0
    capsys.readouterr()
    top = f"{root}/reports/publish/mcp/snapshot/wiki"
    assert sorted(os.path.relpath(os.path.join(d, f), top) for d, _, fs in os.walk(top) for f in fs) == ["a.md", "x/g.md"]
    assert json.load(open(f"{root}/reports/publish/mcp/manifest.json", encoding="utf-8"))["pages"] == 2


def test_validation_rules(spark, tmp_path, capsys):
    pages = {"a.md": "---\nprofile: general\ntitle: A\nsources: [raw/a.txt, raw/none.txt, https://x.org/]\n---\ntext", "B.md": "plain", "b.md": "---\nprofile: lost\n---\ntext"}
    root = knowledge(tmp_path / "kb", pages, None, **{"raw__a.txt": "note", "raw__z.txt": "note z", "query-log.jsonl__x.json": "broken\n"})
    (tmp_path / "kb/profiles/general.json").write_text('{"fields": ["title", "owner"]}', "utf-8")
    (tmp_path / "kb/delivery-contract.json").write_text('{"retrieval": {"top_k": 0}, "publish": {"mode": "web"}, "core_direction": 3, "own": 1}', "utf-8")
    (tmp_path / "kb/retrieval-evals.jsonl").write_text('{"eval_id": "e"}\n{"eval_id": \n', "utf-8")

    def told():
        assert cli.main(["validate", root, "--json"]) == 1
        return {(x["rule"], x["page_id"], x["message"]) for x in json.loads(capsys.readouterr().out)}

    found = told()
    assert {x[:2] for x in found} >= {("unknown_source", "a"), ("missing_field", "a"), ("missing_front_matter", "B"), ("unknown_profile", "b"), ("duplicate_page_id", "b"), ("duplicate_page_id", "B"), ("corrupt_line", "query-log.jsonl"), ("corrupt_line", "retrieval-evals.jsonl")}
    assert {x[2] for x in found if x[0] == "bad_contract"} == {"retrieval.top_k must be positive", "publish.mode must be snapshot or linked", "core_direction must be of type str"}
    assert {x[2] for x in found if x[0] == "missing_field"} == {"profile general requires owner"} and {x[2] for x in found if x[0] == "unknown_source"} == {"no raw note raw/none.txt"}
    assert not {x for x in found if x[0] in ("stale_artifact", "raw_drift")}  # no index yet
    (tmp_path / "kb/delivery-contract.json").unlink()
    assert cli.main(["build-index", root, "--write"]) == 0
    (tmp_path / "kb/wiki/B.md").write_text("changed", "utf-8")
    (tmp_path / "kb/wiki/new.md").write_text("new", "utf-8")
    (tmp_path / "kb/wiki/b.md").unlink()
    (tmp_path / "kb/raw/a.txt").write_text("another note", "utf-8")
    (tmp_path / "kb/raw/z.txt").unlink()
    capsys.readouterr()
    assert {x for x in told() if x[0] in ("stale_artifact", "raw_drift")} == {("stale_artifact", f"{p}.md", f"page is {s} since the index was built") for p, s in (("B", "changed"), ("new", "new"), ("b", "gone"))} | {("raw_drift", f"{p}.txt", f"raw is {s} since the index was built") for p, s in (("a", "changed"), ("z", "gone"))}
    (tmp_path / "kb/delivery-contract.json").write_text("not json", "utf-8")
    assert any(x[0] == "bad_contract" for x in told())


def test_settings_of_the_contract_are_read(spark, tmp_path, capsys):
    pages = {"a.md": "the fox [ftp](ftp://x.org/) [web](https://x.org/)", "b.md": "ein fuchs"}
    root = knowledge(tmp_path / "kb", pages, {"retrieval": {"glossary": False}, "publish": {"safe_schemes": ["ftp"]}})
    (tmp_path / "kb/glossary.json").write_text(json.dumps([{"term": "fox", "lang": "en", "equivalents": [{"term": "fuchs", "lang": "de"}]}]), "utf-8")
    ranked = lambda: {r["page_id"] for r in cli.retrieved(spark, root, "fox", 10, None)[2].collect()}
    assert ranked() == {"a"}
    assert cli.main(["publish-html", root]) == 0
    html = open(f"{root}/reports/publish/html/a.html", encoding="utf-8").read()
    assert 'href="ftp://x.org/"' in html and "https://x.org" not in html
    (tmp_path / "kb/delivery-contract.json").unlink()
    assert ranked() == {"a", "b"}
    capsys.readouterr()


def test_reports_are_whole(spark, capsys):
    cli._tell(spark.range(2500), True)
    assert len(json.loads(capsys.readouterr().out)) == 2500
    cli._tell(spark.range(0), True)
    assert json.loads(capsys.readouterr().out) == []
    cli._tell(spark.range(1500), False)
    assert len(capsys.readouterr().out.splitlines()) == 1500


def test_a_slug_that_most_pages_have(spark):
    rows = spark.range(5000).selectExpr("id as page_id", "if(id % 5 = 4, concat('own ', id), '') as title")
    got = {r["page_id"]: r["file_name"] for r in index.file_names(rows).collect()}
    hot = [i for i in range(5000) if i % 5 != 4]
    assert [got[i] for i in hot] == ["section.html", *(f"section--{k}.html" for k in range(2, len(hot) + 1))] and len(set(got.values())) == 5000


def test_long_titles_keep_their_own_names(spark):
    titles = ["word " * 100 + x for x in ("a", "b", "a")] + ["é" * 90, "e" * 180]
    rows = spark.createDataFrame(list(enumerate(titles)), "page_id int, title string")
    names = [r["file_name"] for r in index.file_names(rows).orderBy("page_id").collect()]
    assert len(set(names)) == 5 and all(len(n.encode()) <= 255 for n in names) and names[2] == names[0].replace(".html", "--2.html")
    assert names[3] == "é" * 90 + ".html" and names[4] == "e" * 180 + ".html"


def test_long_chains_and_cycles_are_followed(spark):
    n = 150
    chain = [(i + 1, i) for i in range(n)] + [(5, 90), (None, 3), (4, None)] + [(1000 + (i + 1) % 7, 1000 + i) for i in range(7)]
    links = spark.createDataFrame(chain, "src long, dst long")
    start = spark.createDataFrame([(0,), (None,), (1003,), (7777,)], "page_id long")
    rows = snapshot.reached(start, links).collect()
    assert len(rows) == n + 1 + 7 + 1 and {r["page_id"] for r in rows} == {*range(n + 1), *range(1000, 1007), 7777}


def test_broadcasts_are_bounded_by_bytes(spark):
    from lorequarry.operators.common import small

    hinted = lambda df, **how: "hint=(strategy=broadcast)" in small(df, **how)._jdf.queryExecution().analyzed().toString() or "ResolvedHint" in small(df, **how)._jdf.queryExecution().analyzed().toString()
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) as t")
    assert hinted(df) and not hinted(df, rows=99) and not hinted(df, size=50_000)


def test_items_of_few_terms_and_of_many(spark):
    pages = spark.createDataFrame([(1, "zero one two three four five six seven eight"), (2, "one, two three"), (3, "no")], "page_id int, text string")
    items = spark.createDataFrame([(n, " ".join("one two three four five six seven eight".split()[:n])) for n in range(1, 9)] + [(20, "one, two")], "query_id int, text string")
    got = sorted(tuple(r) for r in evals.containing(pages, items).collect())
    assert got == sorted([(n, 1) for n in range(1, 9)] + [(1, 2), (20, 2)])
