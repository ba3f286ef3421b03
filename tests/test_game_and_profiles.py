"""The game learner against a plain fold, and the remaining profiles and files."""

import json
import random

from pyspark.sql import functions as F

from palimpsest.operators import evaluate, export, game


def test_states(spark):
    rows = [("cactus", 35, 6.0, True, False, 0), ("bird", 600, 12.0, False, False, -1), (None, None, None, None, None, None), ("bird", 36, 13.5, True, True, 0)]
    df = spark.createDataFrame(rows, "p string, d int, s double, g boolean, k boolean, v int")
    got = [r.s for r in df.select(game.game_state(*[F.col(c) for c in "pdsgkv"]).alias("s")).collect()]
    assert got == ["cactus|0|ground|0", "none|8|airUp|3", "none|8|ground|0", "bird|1|duck|4"]


def test_learning_is_the_fold_of_the_steps(spark):
    rng = random.Random(1)
    names = ["cactus|1|ground|0", "none|8|ground|0", "birdMid|2|duck|1", "x|5|airUp|0"]
    steps = [(p, i, rng.choice(names), rng.randrange(3), rng.random(), rng.choice(names), rng.random() < 0.2) for p in (1, 2) for i in range(40)]
    values = {}
    for p in (1, 2):
        recent = []
        for _, _, s, a, r, n, done in [x for x in steps if x[0] == p]:
            def put(s, a, r, n, done):
                best = max(values.setdefault((p, n), game.prior(n)))
                row = values.setdefault((p, s), game.prior(s))
                row[a] += 0.18 * (r + (0 if done else 0.96 * best) - row[a])

            put(s, a, r, n, done)
            if done:
                for k, (s2, a2, n2) in enumerate(recent[::-1]):
                    put(s2, a2, -18 * 0.82**k, n2, True)
                recent = []
            else:
                recent = [*recent, (s, a, n)][-14:]
    rng.shuffle(steps)
    policy = game.learn(spark.createDataFrame(steps, "player int, seq int, state string, action int, reward double, next_state string, done boolean").repartition(5))
    got = {(r.player, r.state, r.action): r.value for r in policy.collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {(p, s, a): round(v, 9) for (p, s), row in values.items() for a, v in enumerate(row)}
    assert {(r.player, r.state): r.action for r in game.best_actions(policy).collect()} == {k: row.index(max(row)) for k, row in values.items()}


def test_speed_and_digits(spark):
    seen = spark.createDataFrame([(1, 0.0, 300.0), (1, 100.0, 240.0), (1, 1000.0, 100.0), (2, 0.0, 5.0)], "player int, at double, x double")
    got = {r.player: r.speed for r in game.estimated_speed(seen).collect()}
    assert abs(got[1] - (6 * 0.75 + 10 * 0.25)) < 1e-9 and got[2] == 6.0
    masks = spark.createDataFrame([(3, [1] * 8), (7, [0] * 4 + [1] * 4)], "digit int, mask array<int>")
    boxes = spark.createDataFrame([("a", [1] * 7 + [0]), ("faint", [1] + [0] * 7)], "box string, mask array<int>")
    assert [(r.box, r.digit) for r in game.match_digits(boxes, masks).collect()] == [("a", 3)]


def test_profiles(spark):
    times = spark.createDataFrame([(1.0, 2.0), (0.5, None)], "a double, b double")
    assert {r.stage: r.seconds for r in evaluate.stage_totals(times, ["a", "b"]).collect()} == {"a": 1.5, "b": 2.0}
    cases = spark.createDataFrame([("retain", "SUSPICIOUS"), ("retain", None), ("probe", "BENIGN_LIKELY")], "expectation string, status string")
    assert {r.expectation: (r.total, r.kept) for r in evaluate.retention(cases).collect()} == {"retain": (2, 1), "probe": (1, 0)}
    runs = spark.createDataFrame([(3, 2, 2, 1.0, 1.0, 1.0, 0.9), (4, 2, 1, 3.0, 0.8, 0.5, 1.0)], "generated int, required int, hits int, elapsed double, detector_recall double, recall double, precision double")
    r = evaluate.matrix_rollup(runs).first()
    assert (r.generated, r.hits, r.mean_elapsed, r.most_elapsed, r.least_recall, r.least_precision) == (7, 3, 2.0, 3.0, 0.5, 0.9)
    machine = spark.createDataFrame([(8, 16000, 1), (8, 16000, 2)], "cpus int, mb int, free int").select(evaluate.machine_fingerprint({"cpu_count": "cpus", "memory_total_mb": "mb", "memory_available_mb": "free"}).alias("f"))
    assert machine.distinct().count() == 1 and len(machine.first().f) == 20
    cache = spark.createDataFrame([(1, "m", 100.0, 6), (1, "m", 100.0, 5), (2, "m", 100.0, 6), (1, "n", 100.0, 6), (1, "m", -1e9, 6)], "schema int, fingerprint string, created_at_epoch double, selected_workers int")
    assert evaluate.usable_tuning(cache, schema=1, fingerprint="m", now=200.0).count() == 1


def test_files(spark, tmp_path):
    for name, raw in (("good", b'{"meta": {}, "findings": []}'), ("mark", b"\xef\xbb\xbf{}"), ("bytes", b"\xff\xfe"), ("json", b"{"), ("empty", b'{"meta": {}}')):
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r.problem for r in export.file_problems(spark, str(tmp_path)).collect()}
    assert got == {"mark": "BYTE_ORDER_MARK", "bytes": "NOT_UTF8", "json": "NOT_JSON", "empty": "NO_FINDINGS"}
    rows = spark.createDataFrame([("aux_001", "DOMAIN_IMPERSONATION_RISK", "SUSPICIOUS", "h", None, 1)], "id string, type string, risk string, hostname string, brand string, seq int")
    at = str(tmp_path / "x.json")
    export.write_auxiliary(rows, "https://a.test", at)
    assert json.load(open(at))["auxiliary_findings"] == [{"id": "aux_001", "type": "DOMAIN_IMPERSONATION_RISK", "risk": "SUSPICIOUS", "hostname": "h"}]
    assert tuple(export.auxiliary_summary(rows).first()) == (1, "h")


def test_many_players_in_one_batch(spark, monkeypatch):
    rng = random.Random(8)
    names = ["cactus|1|ground|0", "none|8|ground|0"]
    steps = [(p, i, rng.choice(names), rng.randrange(3), rng.random(), rng.choice(names), rng.random() < 0.2) for p in [*range(60), None] for i in range(rng.randint(1, 30))]
    rng.shuffle(steps)
    df = lambda rows: spark.createDataFrame(rows, "player int, seq int, state string, action int, reward double, next_state string, done boolean")
    alone = lambda p: [tuple(r) for r in game.learn(df([s for s in steps if s[0] == p])).collect()]
    monkeypatch.setattr(game, "OUT", 7)
    plan = game.learn(df(steps).coalesce(1))
    assert "FlatMapGroups" not in plan._jdf.queryExecution().executedPlan().toString()  # groups of a few rows each cost far more than their steps
    got = [tuple(r) for r in plan.collect()]
    for p in (0, 31, None):
        assert sorted(r for r in got if r[0] == p) == sorted(alone(p))
    assert {r[0] for r in got} == {*range(60), None} and game.learn(df(steps).limit(0)).count() == 0
