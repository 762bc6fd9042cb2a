from millrace.sources import sinks


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "fnv1a:1", "email", "UK", "block", 40, 20, ["A:block", "B:warn"]), (2, "fnv1a:2", "email", "DE", "approve", 0, 20, [])],
        "draft_id long, draft_hash string, channel string, market string, decision string, risk_score int, threshold int, findings array<string>",
    )
    sinks.write_verdicts(rows, str(tmp_path / "v"))
    back = {r.draft_id: (r.decision, r.findings) for r in spark.read.csv(str(tmp_path / "v"), header=True, inferSchema=True).collect()}
    assert back == {1: ("block", "A:block; B:warn"), 2: ("approve", None)}
    clean = spark.createDataFrame([("1", 'Anna "Lena"\nMüller', "")], "id string, name string, merged_from string")
    sinks.write_merged(clean, clean.select("id"), str(tmp_path / "m"))
    (got,) = spark.read.csv(str(tmp_path / "m/clean"), header=True, quote='"', escape='"', multiLine=True).collect()
    assert (got.id, got.name) == ("1", 'Anna "Lena"\nMüller')
    sinks.write_report({"totals": rows.select("draft_id", "findings"), "empty": rows.limit(0)}, str(tmp_path / "r"))
    assert {r.draft_id: r.findings for r in spark.read.json(str(tmp_path / "r/totals")).collect()} == {1: ["A:block", "B:warn"], 2: []}
