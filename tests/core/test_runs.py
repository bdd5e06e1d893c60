import json

from pyspark.sql import functions as F

from tessella.operators import coverage, naming, planning, records, replies, scheduling, selection

SOURCES = "run_id int, src_idx int, label string, model string, kind string, text string, quality_hint string"


def sources(spark, *rows):
    return spark.createDataFrame([(r, i, f"l{i}", "m", k, t, None) for r, i, k, t in rows], SOURCES)


def test_selection(spark):
    s = sources(
        spark, (1, 0, "asr-live", "live"), (1, 1, "user", "u"), (1, 2, "asr-final", "a"), (1, 3, "external", " a\n"), (1, 4, "asr-final", "b"),
        (2, 0, "asr-live", "x"), (2, 1, "external", "y"), (3, 0, "user", " \t"),
    )
    chosen = selection.cleanup_sources(s).orderBy("run_id", "pick").collect()
    assert [(r["run_id"], r["src_idx"]) for r in chosen] == [(1, 2), (1, 4), (1, 1), (1, 3), (2, 0), (2, 1), (3, 0)]
    assert {(r["run_id"], r["src_idx"]) for r in selection.deduplicated(selection.non_blank(s)).collect()} == {(1, 0), (1, 1), (1, 2), (1, 4), (2, 0), (2, 1)}
    assert {r["run_id"]: r["raw_text"] for r in selection.raw_text(s).collect()} == {1: "a", 2: "x", 3: " \t"}
    assert selection.first_labelled(s, "l1").count() == 2 and selection.of_kind(s, "user").count() == 2 and selection.invalid_kinds(s).count() == 0
    shown = selection.distinct_displays(s.withColumn("display", F.lit("d"))).filter("run_id = 1").orderBy("src_idx").collect()
    assert [r["display"] for r in shown][:3] == ["d", "d (2)", "d (3)"]
    assert selection.numbered_labels(s).filter("run_id = 2").orderBy("src_idx").first()["label"] == "asr1"
    assert selection.panels(s, s.filter("run_id = 2").select("run_id", "text", "model").limit(1)).filter("run_id = 1").count() == 2
    hosted = selection.hosted_names(s.withColumn("backend", F.lit("web")).withColumn("display", F.col("kind")), ["web"])
    assert hosted.filter("run_id = 1").first()["names"] == ["asr-live", "user", "asr-final", "external"]


def test_plan(spark):
    s = sources(spark, (1, 0, "user", "one two three"), (1, 1, "user", "one two three "), (1, 2, "user", "four five"), (2, 0, "user", "w " * 20_000), (3, 0, "user", " "))
    plan = {r["run_id"]: r for r in planning.request_plan(s, context=8000, cap=8192).collect()}
    assert set(plan) == {1, 2} and plan[1]["sources"] == 2
    # Two and three words: the mean of 2.5 is rounded half to even.
    assert (plan[1]["reference_words"], plan[1]["minimum_words"], plan[1]["skip_reason"]) == (2, 2, None)
    assert plan[2]["cap_limited"] and plan[2]["skip_reason"] == "output cap" and plan[2]["output_tokens"] == 8192
    assert planning.request_plan(s, context=4200).filter("run_id = 1").first()["skip_reason"] == "context"
    text = planning.prompts(s).filter("run_id = 1").first()["prompt"]
    assert text.startswith("Recording\n\nSource 1 - l0 (m) - 13 chars / 3 words:\none two three\n\nSource 2") and text.endswith("\n\nWrite the whole transcript.")
    message = planning.request_messages(planning.prompts(s), "sys").first()["messages"]
    assert [m["role"] for m in message] == ["system", "user"]
    modes = spark.createDataFrame(
        [(1, "none", "a", None, None, None), (2, "off", "a", None, None, None), (3, "heuristic", "um a", None, None, None), (4, "llama", "a", "r", None, None),
         (5, "llama", "a", None, "suspiciously short (1", None), (6, "llama", "a", None, None, "context")],
        "run_id int, mode string, first_text string, reply string, error string, skip_reason string",
    )
    assert {r["run_id"]: tuple(r)[1:] for r in planning.cleaned_by_mode(modes).collect()} == {
        1: ("", None, False), 2: ("a", None, False), 3: ("A.", None, False), 4: ("r", None, False), 5: ("", "suspiciously short (1", True), 6: ("", "context", True),
    }


def test_fallback(spark):
    kind = "run_id int, attempt_idx int, model string, http_status int, reason string"
    rows = [(1, 0, "a", 404, "gone"), (1, 1, "b", 200, "short"), (1, 2, "c", 200, None), (1, 3, "d", 200, None), (2, 0, "a", 401, "key"), (2, 1, "b", 200, None), (3, 0, "a", 413, "big")]
    got = {r["run_id"]: tuple(r)[1:] for r in replies.fallback(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("c", 3, False, "gone; short"), 2: (None, 1, True, "key"), 3: (None, 1, False, "big")}
    models = spark.createDataFrame([(1, 0, "x:free"), (1, 1, "y"), (2, 0, "z:free")], "run_id int, pref_idx int, model string")
    kept = {(r["run_id"], r["model"]): r["kept"] for r in replies.available_models(models, models.select("model").filter("model = 'y'")).collect()}
    assert kept == {(1, "x:free"): False, (1, "y"): True, (2, "z:free"): True}
    assert {r["run_id"]: r["all_free"] for r in replies.all_free(models).collect()} == {1: False, 2: True}


def test_acceptance(spark):
    def of(f, *values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, c string")
        return [r[0] for r in rows.orderBy("i").select(f(F.col("c"))).collect()]

    good = {"choices": [{"finish_reason": "stop", "message": {"content": "hi"}}]}
    bad = [None, "x", "[]", "{}", '{"choices": []}', '{"choices": [null]}', json.dumps(good | {"error": {"m": 1}}), '{"choices":[{"finish_reason":"length","message":{"content":"a"}}]}', '{"choices":[{"message":{"content":" "}}]}']
    got = of(replies.rejection, json.dumps(good), *bad)
    assert got[0] is None and all(got[1:]) and got[7] == "truncated at the output limit" or got[8] == "truncated at the output limit"
    assert of(replies.speech_rejection, '{"text": "a"}', '{"text": "a", "error": "e"}', '{"text": 3}', "[]", '{"text": "a", "error": null}') == [None, "provider error", "no text", "not an object", None]
    assert of(replies.flattened_content, '" a "', '[{"type":"text","text":"a "},{"type":"text","text":"b"}]', '[{"type":"image"}]', "3", None) == ["a", "a\nb", "", "", ""]
    rows = spark.createDataFrame([(1, "a b c d", None, 3), (2, "a", None, 3), (3, " ", None, 1), (4, "x", "cut", 1), (5, "The *demo*, text", None, 1)], "i int, content string, failure string, minimum_words int")
    demos = spark.createDataFrame([("the demo text",)], "text string")
    assert {r["i"]: r["rejected"] for r in replies.cleanup_rejection(rows, demos).collect()} == {
        1: None, 2: "incomplete cleanup: suspiciously short (1 words < 3 expected)", 3: "empty output", 4: "cut", 5: "incomplete cleanup: a worked example",
    }


def test_scheduling(spark):
    specs = spark.createDataFrame([(1, "whisper:org/m:v2@cuda:0, web ,ctc@cpu"), (2, "")], "run_id int, spec string")
    parsed = scheduling.parsed_specs(specs).orderBy("src_idx").collect()
    assert [tuple(r)[2:] for r in parsed] == [("whisper", "org/m:v2", "cuda:0"), ("web", "", "auto"), ("ctc", "", "cpu")]
    known = scheduling.backends(spark, [("whisper", "d1", "gpu", "0"), ("web", "d2", "net", "net")])
    rows = {r["backend"]: r for r in scheduling.resolved(scheduling.parsed_specs(specs), known).collect()}
    assert rows["web"]["model"] == "d2" and rows["web"]["device"] == "net" and rows["ctc"]["error"] == "unknown backend ctc"
    groups = scheduling.scheduling_groups(spark.createDataFrame([(1, 0, "gpu"), (1, 1, "net"), (1, 2, "gpu"), (1, 3, "net")], "run_id int, src_idx int, device_kind string"))
    assert [(r["queue"], r["turn"]) for r in groups.orderBy("src_idx").collect()] == [("gpu", 1), ("net:1", 1), ("gpu", 2), ("net:3", 1)]
    options = spark.createDataFrame([(1, "a", None, "f", "p", "d"), (2, "a", None, None, None, "d")], "run_id int, name string, flag string, file string, preset string, default string")
    assert [(r["value"], r["origin"]) for r in scheduling.effective_options(options).orderBy("run_id").collect()] == [("f", "file"), ("d", "default")]
    assert [(r["run_id"], r["rule"]) for r in scheduling.violations(options, {"has file": "file is not null"}).collect()] == [(2, "has file")]
    ladder = spark.createDataFrame([(1, 0, 90), (1, 1, 40), (1, 2, 10), (2, 0, 5)], "rec_id int, rung int, size int")
    assert {r["rec_id"]: r["rung"] for r in scheduling.bitrate_ladder(ladder, 50).collect()} == {1: 1, 2: 0}
    prefs = spark.createDataFrame([(0, 16000), (1, 48000)], "rank int, value int")
    can = spark.createDataFrame([("a", 48000), ("b", 48000), ("b", 16000)], "device string, value int")
    assert {r["device"]: r["value"] for r in scheduling.first_supported(prefs, can, "device").collect()} == {"a": 48000, "b": 16000}
    ids = spark.createDataFrame([("3",), (" ",), ("usb",), (None,)], "d string").select(scheduling.device_id(F.col("d"))).collect()
    assert [tuple(r[0]) for r in ids] == [(3, None), (None, None), (None, "usb"), (None, None)]
    devices = spark.createDataFrame([("b", 1, False), ("Mic", 1, False), ("z", 2, True), ("out", 0, False)], "name string, channels int, is_default boolean")
    assert [r["name"] for r in scheduling.ordered_devices(devices).collect()] == ["z", "Mic", "b"]
    runs = spark.createDataFrame([(["x"], True), ([], False)], "hosted array<string>, cleanup_hosted boolean")
    assert [r["announcement"] for r in scheduling.announcements(runs).collect()] == ["audio and text are sent", "nothing is sent"]
    local = spark.createDataFrame([("/a/o.gguf", None, "m"), (None, None, "d/m.GGUF"), (None, None, "m")], "owned_path string, server_path string, served_model string")
    assert [(r["checkpoint"], r["checkpoint_origin"]) for r in scheduling.checkpoint_identity(local).collect()] == [("o.gguf", "process"), ("m.GGUF", "reply"), (None, "unknown")]


def test_records(spark):
    kind = "run_id int, label string, model string, text string, skip_reason string, error string, seconds double, duration double"
    rows = [(1, "a", "parakeet-x", "[0, 1]: hi  there", None, None, 2.0, 9.0), (1, "b", "m", " ", None, None, 0.0, 9.0), (1, "c", "m", None, None, "boom", 1.0, None), (1, "d", "m", None, "big", None, None, None)]
    got = {r["label"]: r for r in records.outcomes(spark.createDataFrame(rows, kind)).collect()}
    assert got["a"]["text"] == "hi there" and got["a"]["realtime_factor"] == 4.5 and got["a"]["ok"]
    assert got["b"]["skip_reason"] == "empty text" and got["b"]["realtime_factor"] is None
    assert all(sum(r[c] is not None for c in ("text", "skip_reason", "error")) == 1 for r in got.values())
    s = sources(spark, (1, 0, "asr-final", "hello you"))
    runs = spark.createDataFrame([(1, "2026-01-01 10:00:00", "hello")], "run_id int, started string, clean_text string").withColumn("started", F.col("started").cast("timestamp"))
    doc = json.loads(records.diagnostics(runs, s, records.outcomes(spark.createDataFrame(rows, kind))).first()["document"])
    assert doc["schema"] == 7 and doc["transcripts"][0]["words"] == 2 and [a["label"] for a in doc["asr"]] == list("abcd")
    log = spark.createDataFrame([(1, "2026-01-01 10:00:00.5", "x", "{}"), (1, "2026-01-01 10:00:02", "y", "{}")], "run_id int, at string, type string, fields string")
    assert [(r["seq"], r["t"]) for r in records.events(log).orderBy("seq").collect()] == [(1, 0.0), (2, 1.5)]
    failed = records.run_failed(spark.createDataFrame([(False, 0, "x"), (False, 1, "x"), (False, 0, None)], "interrupted boolean, errors int, output string"))
    assert [r["failed"] for r in failed.collect()] == [False, True, True]
    report = spark.createDataFrame([(1, "s", "r", None, 3, "note", False)], "run_id int, served string, requested string, checkpoint string, marked int, audit_note string, full_auto boolean")
    assert [r["line"] for r in records.report_lines(report).orderBy("line_no").collect()] == ["model s for r", "3 passages marked"]


def test_coverage(spark):
    kind = "rec_id int, text string, truncated boolean, audio_seconds double, segments array<struct<start:double,end:double,text:string>>"
    nan = float("nan")
    good = [(0.0, 1.0, "a"), (1.001, 2.0, "b")]
    rows = [
        (0, "a  b", False, 2.001, good), (1, "a b", False, 3.0, good), (2, "a b", False, 2.0, [good[0], (1.2, 2.0, "b")]), (3, "a c", False, 2.0, good), (4, "a b", True, 2.0, good),
        (5, "a", False, 1.0, [(0.0, nan, "a")]), (6, "", False, 5.0, []), (7, "x", False, 5.0, []), (8, "a", False, 0.0, [(0.0, 0.0, "a")]), (9, None, False, 1.0, []), (10, "a", False, nan, good),
        (11, "a", False, 1.0, [(0.0, 1.0, None)]),
    ]
    got = {r["rec_id"]: r["fault"] for r in coverage.coverage(spark.createDataFrame(rows, kind)).collect()}
    assert [got[i] for i in range(12)] == [
        None, "short end", "gap or overlap", "text differs from windows", "truncated", "bad window", None, "text without windows", "empty window", "incomplete reply", "bad length", "bad window",
    ]
    parts = spark.createDataFrame([(1, 1, " b "), (1, 0, "a"), (1, 2, None)], "rec_id int, k int, text string")
    assert coverage.assembled(parts).first()["text"] == "a b"


def test_naming(spark):
    inputs = spark.createDataFrame([(1, 0, "talk-whisper"), (1, 1, "talk-raw"), (1, 2, "x-raw")], "run_id int, idx int, stem string")
    assert naming.run_stems(inputs).first()["stem"] == "talk-whisper-raw"
    rows = naming.unique_names(spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "i int, s string"), "s", "i").orderBy("i").collect()
    assert [r["name"] for r in rows] == ["a", "a-2", "b"]
    files = naming.export_names(spark.createDataFrame([(1, 4, "Asr One"), (1, 2, "x")], "run_id int, src_idx int, label string")).orderBy("src_idx").collect()
    assert [r["file"] for r in files] == ["01-x.txt", "02-asr-one.txt"]
    runs = spark.createDataFrame([(1, "base", "lab/m:free", True), (2, "b", "m", False)], "run_id int, base string, producer string, rejected boolean")
    heard = spark.createDataFrame([(1, 0, "whisper-cpp", "medium"), (1, 1, "ctc", "org/c")], "run_id int, src_idx int, backend string, model string")
    assert {r["run_id"]: r["stem"] for r in naming.produced_stems(runs, heard).collect()} == {1: "base-whisper-medium-c-m-too-short-clean", 2: "b-m-clean"}


def test_unique_names_avoid_other_stems(spark):
    stems = ["a", "a", "a-2", "a", "a-2", "b-3", "b", "b", "b", "a-02", "a-2-2", "x-1", "x", "x"]
    rows = naming.unique_names(spark.createDataFrame(list(enumerate(stems)), "i int, s string"), "s", "i").orderBy("i").collect()
    names = [r["name"] for r in rows]
    assert len(set(names)) == len(names) and names[:4] == ["a", "a-3", "a-2", "a-4"] and names[6:9] == ["b", "b-2", "b-4"]
    assert rows[0].asDict().keys() == {"i", "s", "name"}


def test_coverage_of_the_known_length(spark):
    kind = "rec_id int, text string, truncated boolean, audio_seconds double, segments array<struct<start:double,end:double,text:string>>, duration double"
    rows = [(1, "a", False, 2.0, [(0.0, 2.0, "a")], 2.005), (2, "a", False, 2.0, [(0.0, 2.0, "a")], 2.5), (3, "a", False, 2.0, [(0.0, 2.0, "a")], None)]
    assert {r["rec_id"]: r["fault"] for r in coverage.coverage(spark.createDataFrame(rows, kind)).collect()} == {1: None, 2: "other length", 3: None}


def test_restricted_backends(spark):
    from tessella.operators.scheduling import restricted

    specs = spark.createDataFrame([(1, "a", "", "auto"), (2, "a", "big", "auto"), (3, "a", "one", "cuda:0"), (4, "b", "big", "gpu"), (5, "a", "ONE", "CPU")], "run_id int, backend string, model string, device string")
    limits = spark.createDataFrame([("a", "one", "cpu", "en")], "backend string, only_model string, only_device string, only_language string")
    of = lambda language: {r["run_id"]: r["error"] for r in restricted(specs, limits, language).collect()}
    assert of("en") == {1: None, 2: "a takes only model one", 3: "a runs only on cpu", 4: None, 5: None}
    assert of("fr")[1] == "a understands only en" and of("auto")[1] is None and of(None)[4] is None


def test_batch_inputs_over_many_entries(spark):
    from tessella.sources.readers import batch_inputs

    rows = [(i * 40_000, f"/p{i % 7}") for i in range(20)]
    got = batch_inputs(spark.createDataFrame(rows, "idx long, path string")).orderBy("item").collect()
    assert [(r["item"], r["path"]) for r in got] == [(i + 1, f"/p{i}") for i in range(7)]


def test_readings_for_display(spark):
    from tessella.operators.evaluation import shown_readings

    kind = "n int, a array<struct<text:string,verbatim:string>>"
    rows = spark.createDataFrame([(1, [("one", "x"), ("", "two"), (None, " three "), (" ", ""), (None, None)])], kind)
    assert rows.select(shown_readings(F.col("a")).alias("t")).first()["t"] == ["one", "two", "three"]
