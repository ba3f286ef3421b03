"""Detectors, merge, decisions, host risks, export, frontier and logs on hand-made rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import context, decide, detect, evaluate, export, frontier, merge, model, rules_v1, url_risk
from palimpsest.sources import html, observations
from palimpsest.streaming import log

BASE = dict(
    url="https://a.test/1", title="t", selector="p#x", text="hello there", scan_pass="desktop-initial", opacity_source=None, display_none_source=None, display="block", visibility="visible", font_size="16px", position="static",
    left="auto", top="auto", effective_opacity=1.0, text_color_alpha=1.0, same_text_background=False, in_viewport=True, page_ord=1, pass_ord=1, elem_ord=1, rect=(0.0, 0.0, 10.0, 10.0),
)


def obs(spark, *rows):
    names = observations.OBSERVATION.names
    return spark.createDataFrame([tuple((BASE | r)[n] for n in names) for r in rows], observations.OBSERVATION)


def reasons(spark, **row):
    return {r.technique: r.reason for r in detect.detect(obs(spark, row)).collect()}


def test_detectors(spark):
    assert reasons(spark) == {}
    assert reasons(spark, effective_opacity=0.0, text_color_alpha=0.0, same_text_background=True) == {"TRANSPARENT": ["OPACITY", "CLEAR_TEXT", "SAME_COLOUR"]}
    assert reasons(spark, display_none_source="p#x", font_size="1px") == {"OFFSCREEN": ["DISPLAY_SELF", "FONT:1.0"]}
    assert reasons(spark, display_none_source="div") == {"OFFSCREEN": ["DISPLAY_ANCESTOR"]}
    assert reasons(spark, position="absolute", left="-9999px") == {"OFFSCREEN": ["FAR"]}
    assert reasons(spark, position="absolute", rect=(0.0, -9000.0, 10.0, 10.0)) == {}  # scrolled away
    assert reasons(spark, position="fixed", rect=(0.0, -9000.0, 10.0, 10.0)) == {"OFFSCREEN": ["FAR"]}
    assert reasons(spark, text="ㄱㅏㅇㅣㅂ") == {"JAMO": ["JAMO"]}
    assert reasons(spark, text="ＦＲＥＥ раy B0NUS") == {"HOMOGLYPH": ["FULLWIDTH", "MIXED", "DIGIT"]}
    assert reasons(spark, text=None, effective_opacity=None, same_text_background=None, font_size=None, rect=None) == {}


def test_merge_is_a_fold_in_order(spark):
    rows = [
        dict(text="short", effective_opacity=0.0, opacity_source="a", pass_ord=1),
        dict(text="a longer text", text_color_alpha=0.0, opacity_source="b", pass_ord=2, scan_pass="mobile-settled"),
        dict(text="same length!!", effective_opacity=0.0, opacity_source=None, pass_ord=3, scan_pass="mobile-settled"),
    ]
    for order in (rows, rows[::-1]):
        (m,) = merge.merge_passes(detect.detect(obs(spark, *order)).repartition(3)).collect()
        assert (m.evidence_text, m.reason, m.observation_count, m.scan_passes, m.opacity_source) == ("a longer text", ["OPACITY", "CLEAR_TEXT"], 3, ["desktop-initial", "mobile-settled"], "b")


def test_context_takes_near_texts_first(spark):
    rows = [dict(selector="div > p#x", text="hidden", effective_opacity=0.0, elem_ord=5)]
    rows += [dict(selector=f"div > p#n{i}", text=f"near {i % 9}", elem_ord=10 + i) for i in range(12)]
    seen = obs(spark, *rows, dict(selector="span", text="elsewhere", elem_ord=2))
    merged = merge.merge_passes(detect.detect(seen))
    (row,) = context.with_context(merged, seen).collect()
    assert row.context == "hidden hidden t " + " ".join(f"near {i}" for i in range(8))


def test_few_neighbours_are_helped_out(spark):
    rows = [dict(selector="main > div > p#x", text="hidden", effective_opacity=0.0, elem_ord=5), dict(selector="main > div > b", text="one"), dict(selector="main > i", text="two", elem_ord=7), dict(selector="main > u", text="one", elem_ord=8)]
    seen = obs(spark, *rows)
    (row,) = context.with_context(merge.merge_passes(detect.detect(seen)), seen).collect()
    assert row.context == "hidden hidden t one two"


SCORED = "technique string, location string, evidence_text string, normalized_text string, reason array<string>, opacity_source string, display_source string, scan_passes array<string>, evidence_a double, context_a double, evidence_b double, context_b double, support_a double, support_b double, repeat_count long, repeat_ratio double, independent_technique_count long, total_pages long, visible_equivalent_count long"
FIVE = ["1", "2", "3", "4", "5"]


def status(spark, **change):
    row = dict(
        technique="JAMO", location="p#x", evidence_text="text", normalized_text="text", reason=["JAMO"], opacity_source=None, display_source=None, scan_passes=FIVE, evidence_a=0.5, context_a=0.5, evidence_b=0.5, context_b=0.5,
        support_a=0.0, support_b=0.0, repeat_count=1, repeat_ratio=0.1, independent_technique_count=1, total_pages=10, visible_equivalent_count=0,
    ) | change
    return decide.decide(spark.createDataFrame([tuple(row.values())], SCORED)).first()


def test_decisions(spark):
    r = status(spark)
    assert r.verification_status == "SUSPICIOUS" and abs(r.open_set_score - 0.64) < 1e-9
    assert status(spark, repeat_count=3, repeat_ratio=0.3).verification_status == "BENIGN_LIKELY"
    assert status(spark, technique="HOMOGLYPH", reason=["DIGIT"]).verification_status == "BENIGN_LIKELY"
    assert status(spark, technique="HOMOGLYPH", reason=["DIGIT"], normalized_text="a​b").verification_status == "SUSPICIOUS"
    clear = dict(technique="TRANSPARENT", reason=["OPACITY"])
    assert abs(status(spark, **clear).open_set_score - 0.57) < 1e-9
    assert status(spark, **clear).verification_status == "BENIGN_LIKELY"
    assert status(spark, **clear, evidence_text="a​b", normalized_text=None).verification_status == "SUSPICIOUS"
    known = dict(evidence_a=0.95, context_a=0.95, evidence_b=0.95, context_b=0.95, support_a=0.9)
    assert status(spark, **clear, **known).verification_status == "CONFIRMED"
    assert status(spark, **clear, **known, visible_equivalent_count=2).verification_status == "BENIGN_LIKELY"
    assert status(spark, **known, support_b=0.1).verification_status == "CONFIRMED"
    assert status(spark, location="nav > a").open_set_score < 0.5
    assert status(spark, normalized_text="메뉴 안내").open_set_score < 0.5
    assert status(spark, technique="OFFSCREEN", reason=["DISPLAY_SELF"]).structure_score == 0.28


def test_model(spark):
    m = model.fit(model.seeds(spark))
    said = ["무료 카지노 가입 코드 지급", "the museum is closed on mondays", "zzqq", "", None]
    got = {r.text: r for r in model.score(spark.createDataFrame([(t,) for t in said], "text string"), m).collect()}
    assert got[said[0]].probability > 0.85 and got[said[1]].probability < 0.1 and got[said[0]].support == 1.0
    assert (got["zzqq"].probability, got[""].probability, got[""].support) == (0.5, 0.5, 0.0) and len(got) == 4


def test_word_rules(spark):
    merged = merge.merge_passes(detect.detect(obs(spark, dict(text="casino", effective_opacity=0.0), dict(text="call on telegram", effective_opacity=0.0, selector="b"), dict(text="x", display_none_source="i", selector="i"), dict(text="a test", url="file:///a", effective_opacity=0.0, selector="u"))))
    assert {r.location: (r.outcome, r.is_violation) for r in rules_v1.verify_by_words(merged).collect()} == {"p#x": ("STRONG_WORDS", True), "b": ("CONTEXT_WORDS", False), "i": ("DISPLAY_NONE_ONLY", False), "u": ("LOCAL_TEST", True)}


def test_host_risks(spark):
    want = {
        "https://twtch-login.test/a": ("Twitch", "DOMAIN_TYPOSQUAT"), "https://faceb00k.test": ("Facebook", "DOMAIN_HOMOGLYPH"), "https://facebook.login-example.test": ("Facebook", "BRAND_ALIAS"),
        "http://xn--pple-43d.com/": ("Apple", "DOMAIN_HOMOGLYPH"), "https://help.twitch.tv": None, "https://civic-service.test": None, "ftp://facebook.test": None, "https://": None,
    }
    got = {r.url: (r.brand, r.signal) for r in url_risk.url_risk(spark.createDataFrame([(u,) for u in want] + [(None,)], "url string")).collect()}
    assert got == {u: w for u, w in want.items() if w}


def test_findings_and_validation(spark, tmp_path):
    rows = spark.createDataFrame([("u", "p", "JAMO", "a", True, 2), ("u", "p", "JAMO", "b", True, 1), ("u", "q", "OFFSCREEN", "c", None, 3)], "url string, location string, technique string, evidence_text string, is_violation boolean, seq int")
    done = export.findings(rows)
    assert [(r.id, r.evidence_text, r.is_violation) for r in done.orderBy("id").collect()] == [("f_001", "b", True), ("f_002", "c", True)]
    at = str(tmp_path / "r.json")
    export.write_result(done, {"topic": "t"}, at)
    raw = open(at, "rb").read()
    assert raw.endswith(b"}\n") and b"\r" not in raw and [f["id"] for f in json.loads(raw)["findings"]] == ["f_001", "f_002"]
    assert export.violations(export.read_result(spark, at)).count() == 0
    bad = spark.createDataFrame([(0, "u", "p", "JAMO"), (1, " ", "p", "JAMO"), (2, "u", None, "JAMO"), (3, "u", "p", "X"), (4, "u", "p", "JAMO")], "row_ord int, url string, location string, technique string")
    assert {r.row_ord: r.problem for r in export.violations(bad).collect()} == {1: "BLANK_URL", 2: "BLANK_LOCATION", 3: "UNKNOWN_TECHNIQUE", 4: "DUPLICATE"}
    events = spark.createDataFrame([("A", "u", 1), ("A", "u", 2), ("B", None, 3)], "type string, page_url string, seq int").withColumns({c: F.lit(None).cast("string") for c in ("download_url", "suggested_filename", "hostname", "signal")})
    assert [r.id for r in export.auxiliary_findings(events).orderBy("id").collect()] == ["aux_001", "aux_002"]
    assert {(r.technique, r.verification_status): r.n for r in export.run_summary(spark.createDataFrame([("J", "S"), ("J", "B")], "technique string, verification_status string")).collect()}[(None, None)] == 2


def test_crawl_follows_a_long_chain(spark):
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(34)], "src string, dst string").coalesce(1)
    got = frontier.crawl(links, spark.createDataFrame([("p0",)], "url string")).collect()
    assert sorted((r.depth, r.url) for r in got) == [(i, f"p{i}") for i in range(35)]


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {r.url: r.depth for r in frontier.crawl(links, spark.createDataFrame([("a",)], "url string")).collect()} == {"a": 0, "b": 1, "c": 2}
    found = spark.createDataFrame([("https://a.test/p/1?utm_a=1", "sitemap", 5), ("https://a.test/p/1", "http", 9), ("https://a.test/p/2", "browser", 6), ("https://a.test/p/3", "browser", 7), ("https://a.test/x.zip", "browser", 1)], "url string, source string, seq int")
    got = {r.url: (r.source_rank, r.pattern_rank, r.seq) for r in frontier.schedule(found).collect()}
    assert got == {"https://a.test/p/1": (1, 0, 5), "https://a.test/p/2": (0, 0, 6), "https://a.test/p/3": (0, 1, 7)}


def test_page_sources(spark):
    page = "<A HREF='x.html'>1</a><a name=q>2</a><a href=\"/y?a=1&amp;b=2\">3</a><a href='x.html'>"
    got = {r.dst for r in html.page_links(spark.createDataFrame([("https://a.test/d/", page), ("https://b.test/", None)], "url string, html string")).collect()}
    assert got == {"https://a.test/d/x.html", "https://a.test/y?a=1&b=2"}
    robots = spark.createDataFrame([("https://a.test/robots.txt", "User-agent: *\r\n SITEMAP: /s.xml\nsitemap:\nSitemap: https://b.test/t.xml")], "url string, text string")
    assert {r.sitemap for r in html.robots_sitemaps(robots).collect()} == {"https://a.test/s.xml", "https://b.test/t.xml"}
    maps = spark.createDataFrame([("https://a.test/s.xml", "<urlset xmlns='n'><url><loc> /p </loc></url></urlset>"), ("https://a.test/i.xml", "<sitemapindex><sitemap><loc>/s.xml</loc></sitemap></sitemapindex>"), ("https://a.test/bad", "<x>")], "url string, text string")
    assert {(r.kind, r.target) for r in html.sitemap_entries(maps).collect()} == {("page", "https://a.test/p"), ("sitemap", "https://a.test/s.xml")}


def test_evaluation(spark):
    truth = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    (r,) = evaluate.precision_recall(truth, spark.createDataFrame([("a",), ("b",), ("x",), ("y",)], "k string"), ["k"]).collect()
    assert (r.hits, r.missing, r.unexpected, r.precision, round(r.recall, 3)) == (2, 1, 2, 0.5, 0.667)
    (none,) = evaluate.precision_recall(truth.limit(0), truth.limit(0), ["k"]).collect()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)
    runs = spark.createDataFrame([(4, 9.6, 0, 1), (6, 10.0, 0, 1), (8, 20.0, 1, 1), (8, 12.0, 0, 0)], "workers int, pages_per_sec double, errors int, observations int")
    assert evaluate.choose_workers(runs).first().workers == 4
    machines = spark.createDataFrame([(4, 99999), (8, 8000), (16, 8000), (16, 64000), (16, None), (8, 4000)], "cpu_count int, memory_total_mb int")
    assert [r.workers for r in evaluate.candidate_workers(machines).collect()] == [[4], [4, 6], [4, 6], [6, 8], [6, 8], [4]]


def test_logs_in_batch_and_as_a_stream(spark, tmp_path):
    lines = ["[RUN][W1] 페이지 정밀 탐색 3: https://a.test/", "[RUN][W1] 완료 2: https://a.test/b", "CONFIRMED : 1,234", "탐지 시간 : 7.5초", "주의: x", "else", "[RUN] 발견 URL 9: u", "[RUN] Auto-Tune : 6"]
    rows = [("r", i, t) for i, t in enumerate(lines)]
    events = spark.createDataFrame(rows, "run string, seq long, line string").select("run", "seq", log.event(F.col("line")).alias("event"))
    assert [r.event.type for r in events.orderBy("seq").collect()] == ["scan", "complete", "summary", "summary", "warning", "log", "discovered", "autotune"]
    want = {"attempted": "3", "completed": "2", "current_url": "https://a.test/b", "confirmed": "1234", "elapsed_sec": "7.5", "warning": "주의: x", "discovered": "9", "autotune": "6"}
    assert {r.metric: r.value for r in log.state(events).collect()} == want
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "a.json", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"run": r, "seq": s, "line": t}) + "\n" for r, s, t in rows)
    live = log.stream_state(spark, str(tmp_path / "in"), "live_state")
    live.processAllAvailable()
    live.stop()
    assert {r.metric: r.value for r in spark.table("live_state").collect()} == want
    ends = spark.createDataFrame([(True, 0, 1, 0), (False, 2, 0, 0), (False, 0, 1, 0), (False, 0, 0, 1), (False, 0, 0, 0)], "cancelled boolean, return_code int, findings int, aux int")
    assert [r.said for r in log.outcome(ends).collect()] == ["cancelled", "error", "findings", "auxiliary only", "nothing"]


def test_statuses_don_t_depend_on_partitions(spark):
    at = "/root/testdata/sf0.001"
    if not os.path.exists(at):
        pytest.skip("no test data")
    seen = observations.derived(spark, at).where("page_ord < 12")
    merged = lambda df: sorted(map(str, merge.merge_passes(detect.detect(df)).collect()))
    assert merged(seen) == merged(seen.repartition(7))


def test_entry(spark):
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 30
    if os.path.exists(__spark_entry__.SMALL):
        assert __spark_entry__.entry(spark).count() > 0


def test_findings_are_numbered_in_order(spark):
    rows = [(f"https://a.test/{i}", "p", f"text {i}", "JAMO", (i * 7919) % 5000) for i in range(3000)]
    got = export.findings(spark.createDataFrame(rows, "url string, location string, evidence_text string, technique string, seq int").repartition(7)).collect()
    want = {u: f"f_{k:03d}" for k, (*_, u) in enumerate(sorted((s, u) for u, _, _, _, s in rows), 1)}
    assert {r.url: r.id for r in got} == want
    assert export.findings(spark.createDataFrame(rows[:1], "url string, location string, evidence_text string, technique string, seq int").limit(0)).count() == 0


def test_unread_pages_are_no_copies(spark):
    rows = [(f"https://a.test/x?p={i}", None if i != 2 else "a", i, False) for i in range(5)]
    assert all(r.kept for r in frontier.content_dedup(spark.createDataFrame(rows, "url string, html string, seq int, partial boolean")).collect())


def test_malformed_addresses_of_sitemaps(spark):
    text = "<urlset><url><loc>http://[x/</loc></url><url><loc>/a</loc></url></urlset>"
    files = spark.createDataFrame([("https://a.test/sitemap.xml", text), (None, text), ("https://b.test/s", None), ("https://c.test/s", "<")], "url string, text string")
    assert sorted((r.url, r.target) for r in html.sitemap_entries(files).collect()) == [("https://a.test/sitemap.xml", "https://a.test/a")]


def test_written_results_need_a_shared_folder():
    from types import SimpleNamespace

    from palimpsest.plans import storage

    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        storage.shared_dir(cluster)


def test_worker_choice_over_all_runs(spark):
    rows = [(4, 96.0, 0, 1), (6, 100.0, 0, 1), (2, 90.0, 0, 1), (1, 200.0, 1, 1)]
    runs = spark.createDataFrame(rows, "workers int, pages_per_sec double, errors int, observations int")
    assert [tuple(r) for r in evaluate.choose_workers(runs).collect()] == [(4, 96.0)]


def test_scripts_and_selectors(spark):
    from palimpsest.functions import text

    want = {"a": "LATIN", "é": "LATIN", "Ａ": "LATIN", "я": "CYRILLIC", "λ": "GREEK", "ㄱ": "HANGUL", "가": "HANGUL", "ひ": "HIRAGANA", "カ": "KATAKANA", "漢": "CJK", "ع": "ARABIC", "א": "HEBREW", "ไ": "THAI", "क": "DEVANAGARI", "ა": "OTHER", "1": None, " ": None}
    rows = spark.createDataFrame([(c,) for c in want], "c string").select("c", text.script_bucket(F.col("c")).alias("s"), text.css_attribute(F.concat("c", F.lit('"\\'))).alias("e")).collect()
    assert {r.c: r.s for r in rows} == want and all(r.e == r.c + '\\"\\\\' for r in rows)


def test_scale_metrics(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    r = evaluate.scale_metrics(keys("a", "b", "c", "d"), keys("x"), keys("a", "b", "c"), keys("a", "b", "x", "z"), ["k"], pages=50, seconds=10.0).first()
    assert (r.expected, r.detected, r.hits, r.leaks, r.unexpected, r.detector_recall, r.recall, r.precision, r.pages_per_second) == (4, 3, 2, 1, 1, 0.75, 0.5, 0.5, 5.0)


def test_validation_of_a_file(spark, tmp_path):
    good = {"meta": {"topic": "t", "elapsed_sec": 1.5}, "findings": [{"id": "f_001", "url": "u", "is_violation": True, "location": "p", "evidence_text": "x", "technique": "JAMO"}]}
    cases = [(good, 0), (good | {"meta": {"topic": 3}}, 1), (good | {"meta": {"elapsed_sec": -1}}, 1), (good | {"meta": {"elapsed_sec": True}}, 1), (good | {"findings": good["findings"] * 2}, 1), ({"meta": {}}, 1)]
    for i, (data, want) in enumerate(cases):
        (tmp_path / f"{i}.json").write_text(json.dumps(data))
        assert export.validate(spark, str(tmp_path / f"{i}.json")) == want


def test_grams_are_counted_as_by_hand(spark, monkeypatch):
    import random
    from collections import Counter

    rng = random.Random(5)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a, n in (("ab ", 300), ("aé가😀", 300), ("x", 1), ("\0ab", 40), ([chr(0x4E00 + i) for i in range(9000)], 30_000))]
    rows = [(t, i % 2) for i, t in enumerate(texts)] + [("ab", None), (None, 1), ("", 0)]
    want = {0: Counter(), 1: Counter(), None: Counter()}
    for t, label in rows:
        said = " ".join((t or "").split(" ")).strip(" ") and f"^{' '.join(t.split())}$"
        want[label].update(said[i : i + n] for n in range(2, 6) for i in range(len(said) - n + 1))
    for piece in (50, 2_000_000):
        monkeypatch.setattr(model, "PIECE", piece)
        table, totals = model.fit(spark.createDataFrame(rows, "text string, label int"))
        got = {r.gram: (r.c0, r.c1) for r in table.collect()}
        assert got == {g: (want[0][g], want[1][g]) for k in want for g in want[k]}
        assert totals.first().total1 == sum(want[1].values())


def test_grams_of_a_long_text_take_time_in_proportion(spark):
    import time

    text = "가나다라 마바사아 " * 40_000  # cut by its places from the start, this took a time with the square of its length
    began = time.time()
    table, _ = model.fit(spark.createDataFrame([(text, 1)], "text string, label int"))
    assert table.agg(F.sum("c1")).first()[0] == 4 * (len(text.strip()) + 2) - 10 and time.time() - began < 60


def test_neighbours_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(11)
    steps = ["a", "b", "c"]
    rows = []
    for i in range(400):
        path = " > ".join([rng.choice(steps) for _ in range(rng.randint(1, 3))] + [f"p{rng.randint(0, 6)}"])
        rows.append(dict(url=f"https://a.test/{rng.randint(0, 3)}", selector=path, text=f"t{rng.randint(0, 25)}", effective_opacity=0.0 if rng.random() < 0.2 else 1.0, pass_ord=rng.randint(1, 3), elem_ord=i))
    seen = obs(spark, *rows)
    up = lambda s: s.rpartition(" > ")[0]
    got = context.with_context(merge.merge_passes(detect.detect(seen)), seen).collect()
    assert len(got) > 40
    for m in got:
        rings = []
        for prefix, most in ((up(m.location), 8), (up(up(m.location)), 6)):
            first = {}
            for r in sorted(rows, key=lambda r: (r["pass_ord"], r["elem_ord"], r["text"])):
                if prefix and r["url"] == m.url and r["selector"] != m.location and r["selector"].startswith(prefix + " > ") and r["text"] not in sum(rings, []):
                    first.setdefault(r["text"])
            rings.append(list(first)[:most])
            if len(rings[0]) >= 4:
                break
        assert m.context == " ".join([m.evidence_text, m.evidence_text, "t", *sum(rings, [])])


def test_scores_in_the_row_are_those_of_the_join(spark):
    models = {x: model.fit(model.seeds(spark, k)) for x, k in (("a", 1), ("b", 2))}
    said = ["무료 카지노 가입 코드 지급", "win a bonus  TODAY", "the museum is closed on mondays", "zzqq", "", "x", "カジノ 😀 bonus", "a\0b casino", None]
    rows = spark.createDataFrame([(t,) for t in said], "text string")
    want = {r.text: r for r in model.score_models(rows, models).drop("key").collect()}
    from palimpsest.functions import text

    score = model.row_scorer(models)
    for r in rows.select("text", score(text.plain(F.col("text"))).alias("s")).collect():
        for c in ("probability_a", "support_a", "probability_b", "support_b"):
            assert abs(r.s[c] - want[r.text or ""][c]) < 1e-9


def test_large_models_are_joined_instead(spark, monkeypatch):
    seen = obs(spark, dict(text="free betting credit", effective_opacity=0.0), dict(selector="main > b", text="ㄱㅏㅇㅣㅂ 코드", elem_ord=2), dict(selector="main > i", text="casino", elem_ord=3))
    models = tuple(model.fit(model.seeds(spark, k)) for k in (1, 2))
    merged = merge.merge_passes(detect.detect(seen))
    told = lambda: sorted((r.location, r.verification_status, round(r.verification_score, 9), r.visible_equivalent_count) for r in decide.verify(merged, seen, models).collect())
    want = told()
    monkeypatch.setattr(model, "ROWWISE", 10)
    assert len(want) == 2 and told() == want


def test_a_text_is_shuffled_once_whatever_passes_show_it(spark):
    seen = obs(spark, *[dict(text=f"ㄱㅏㅇㅣㅂ {i % 9}", elem_ord=i, pass_ord=p, selector=f"p#{i}") for i in range(90) for p in range(5)])
    plan = detect.detect(seen)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
    profile = evaluate.pass_profile(merge.merge_passes(detect.detect(seen)))._jdf.queryExecution().optimizedPlan().toString()
    assert "normalized_text" not in profile.split("Aggregate")[1] and "composed" not in profile


def test_hosts_are_judged_once(spark):
    rows = [(f"https://twtch-login.test/{i % 40}",) for i in range(80)] + [("https://a.test/",)] * 3
    done = url_risk.url_risk(spark.createDataFrame(rows, "url string"))
    assert sorted(r.url for r in done.collect()) == sorted({u for u, in rows[:80]})
    # No address is compared with brands: of a join on hosts alone the optimizer inferred that each had to be.
    assert "levenshtein" not in done._jdf.queryExecution().optimizedPlan().toString()
