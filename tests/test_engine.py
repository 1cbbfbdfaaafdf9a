"""Edge cases, fits and engines on small tables."""

import http.server
import io
import json
import math
import random
import threading
import zipfile
from statistics import NormalDist
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import categories, flatten, metrics, profile, rules, sampling, states
from plumbline.operators import transforms as X
from plumbline.plans import improve, monitor, policy, remediate
from plumbline.sources import audit, files, loader, opendata, rest
from plumbline.streaming import live
from plumbline.types import content_types, logical_types, parse_time


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, float(v) if kind == "double" and v is not None else v) for i, v in enumerate(values)], f"i int, x {kind}")


def out(df, *transforms):
    return [r.x for r in X.transformed(df, {"x": list(transforms)}).orderBy("i").collect()]


def test_profile_of_known_values_and_edges(spark):
    m = {r.metric: r.value for r in profile.numeric(column(spark, [1.0, 2, 2, 3, 4, 5, 9, 40]), ["x"]).collect()}
    assert m["skewness"] == pytest.approx(2.6354710937647186) and m["kurtosis"] == pytest.approx(7.127397754125022)
    assert (m["p25"], m["median"], m["p75"]) == (2, 3.5, 6) and m["std"] == pytest.approx(13.068500843085035)
    for values in ([], [None, None], [float("nan"), None], [5.0, 5.0, 5.0], [1.0]):
        m = {r.metric: r.value for r in profile.numeric(column(spark, values), ["x"]).collect()}
        assert 0 <= m["quality_score"] <= 100
        assert m["null_percentage"] == (100.0 if values and all(v is None or math.isnan(v) for v in values) else 0.0 if values else None)
    assert profile.temporal(column(spark, [], "timestamp"), "x").first().max_gap is None
    assert profile.mad_outliers(column(spark, [1.0, 2, 2, 3, 4, 5, 9, 40]), ["x"]).first().mad == 1.5


def test_rules_on_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (None, None), (-1, "a\n")], "n int, s string")
    found = {(r.rule, r.field): r.violations for r in rules.evaluate(df, [rules.positive(df, "n"), rules.not_null(df, "n"), rules.allowed_values(df, "s", ["a"]), rules.allowed_values(df, "s", ["a", None]), rules.regex(df, "s", "[a-z]"), rules.string_length(df, "s", 1, 2), rules.outlier(df, "n")]).collect()}
    assert found[("positive", "n")] == 1 and found[("not_null", "n")] == 1 and found[("allowed_values", "s")] in (1, 2) and found[("regex", "s")] == 2 and found[("string_length", "s")] == 1
    assert rules.unique(spark.createDataFrame([(None,), (None,), (1,)], "n int"), "n").first().violations == 1
    assert rules.foreign_key(df, "n", spark.createDataFrame([(1,)], "k int"), "k").first().violations == 2
    with pytest.raises(ValueError):
        rules.named(df, "nothing", "n")


def test_power_transforms_are_at_the_best_likelihood(spark):
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(size=400)) * 3
    df = column(spark, x.tolist())
    lam = X._best(X.fit(df, [("x", X.boxcox)])["x", X.boxcox.name], X.FINER - 1)

    def llf(v):
        y = np.log(x) if abs(v) < 1e-9 else (x**v - 1) / v
        return (v - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())

    assert abs(lam) < 0.15 and llf(lam) >= max(llf(lam + 0.01), llf(lam - 0.01))
    y = np.array(out(df, X.yeojohnson))
    assert abs(y.mean()) < 1e-6 and abs(y.std() - 1) < 1e-6 and (np.argsort(y) == np.argsort(x)).all()
    z = np.array(out(df, X.quantile_normal))
    order = np.argsort(x)
    want = [NormalDist().inv_cdf(min(max(i / 399, 1e-7), 1 - 1e-7)) for i in range(400)]
    assert np.allclose(z[order], want, atol=1e-6)


def test_transforms_on_edges(spark):
    assert out(column(spark, [None, 1.0, 3.0]), X.impute_median) == [2.0, 1.0, 3.0]
    assert out(column(spark, [None, 2.0, 2.0]), X.minmax) == [None, 0.0, 0.0] and out(column(spark, [2.0, 2.0]), X.zscore) == [2.0, 2.0]
    for t in (X.winsorize, X.minmax, X.zscore, X.log_shift, X.boxcox, X.yeojohnson, X.quantile_normal, X.impute_median):
        assert out(column(spark, [None, None]), t) == [None, None] and out(column(spark, []), t) == []
    clipped = X.transformed(column(spark, [1.0, 2, 3, 4, 1000]), {"x": [X.winsorize]})
    assert [r.x for r in clipped.orderBy("i").collect()] == [1, 2, 3, 4, 7]
    times = column(spark, ["1970-01-01", "2020-02-03", "2020-02-03", "2021-01-01", None], "string").withColumn("x", F.col("x").cast("timestamp"))
    assert [str(v)[:10] for v in out(times, X.mode_date())] == ["2020-02-03", "2020-02-03", "2020-02-03", "2021-01-01", "2020-02-03"]
    assert out(times, X.mode_date(False))[4] is None and len(out(times, X.temporal_log, X.cyclical)) == 5
    assert out(column(spark, ["abcd", "abc", None], "string"), X.mask) == ["ab***", "abc", None]
    assert out(column(spark, ["El Camión, de LA casa!", None], "string"), X.clean_text)[0] == "camion casa"
    grouped = [r.x for r in X.group_rare(column(spark, ["a"] * 9 + ["b"] * 5 + ["c"] * 5 + ["d"], "string"), "x").orderBy("i").collect()]
    assert grouped[-1] == "Other" and grouped[0] == "a"
    merged = [r.x for r in X.merge_similar(column(spark, ["color", "colour", "zebra", "mat"], "string"), "x").orderBy("i").collect()]
    assert merged == ["color", "color", "mat", "mat"]  # likeness 0.91 and 0.25; the third quartile of all pairs is 0.24


def test_times_from_any_shape(spark):
    df = spark.sql("select named_struct('year', 2023, 'month', 2, 'day', 29) a, named_struct('year', 2023) b, array(2020, 1, 2, 3, 4) c, array(2020, 1, 2, 3, 4, 5) d, 86400 e, 'nothing' f")
    row = df.select(*(F.date_format(parse_time(df, n), "yyyy-MM-dd HH:mm:ss").alias(n) for n in df.columns)).first()
    assert list(row) == [None, "2023-01-01 00:00:00", "2020-01-02 00:00:00", "2020-01-02 03:04:05", "1970-01-02 00:00:00", None]
    kinds = content_types(spark.createDataFrame([("1", "2020-01-01", "True", "x"), (None, None, "False", "y")], "a string, b string, c string, d string"), True)
    assert kinds == {"a": "integer", "b": "datetime", "c": "boolean", "d": "string"}


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 900, "big").when(F.col("id") < 990, "small"))
    first = {r.id for r in sampling.simple(df, 37, keys=["id"]).collect()}
    assert len(first) == 37 and first == {r.id for r in sampling.simple(df.repartition(7), 37, keys=["id"]).collect()}
    got = {r.s: r["count"] for r in sampling.stratified(df, "s", {"big": 5}, keys=["id"]).groupBy("s").count().collect()}
    assert got == {"big": 5, "small": 90}
    assert sampling.stratified(df, "s", {"big": 5000, "small": 0}, keys=["id"], keep_null=True).count() == 910
    assert sampling.sample_size(1_000_000) == 385 and sampling.z_value(0.95) == 1.96
    with pytest.raises(ValueError):
        sampling.sample_size(0)


def test_nested_data_becomes_flat(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}, "c": [{"d": "x"}, {"d": "y"}], "e": []}',), ("not json",)], "j string")
    flat = flatten.flatten(flatten.parse_json(df, "j"))
    assert {"j_a_b", "j_c_0_d", "j_c_1_d"} <= set(flat.columns)
    assert [r.j_c_1_d for r in flat.collect()] == ["y", None]
    assert flatten.flatten(flatten.parse_json(df, "j"), max_depth=1).columns[0] == "j_a"


def workbook(path):
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="one" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><t>n</t></si><si><t>ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>1.5</v></c></row><row><c r="B3"><v>2</v></c></row></sheetData></worksheet>')
    path.write_bytes(data.getvalue())


def test_files(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    df = files.read_excel(spark, str(tmp_path / "a.xlsx"), "one")
    assert df.dtypes == [("name", "string"), ("n", "double")] and [tuple(r) for r in df.collect()] == [("ann", 1.5), (None, 2.0)]
    (tmp_path / "a.csv").write_text("k;v\n1;x\n2;\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv"), ";").count() == 2


@pytest.fixture
def service():
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            at = int(parse_qs(urlparse(self.path).query).get("at", ["0"])[0])
            body = json.dumps({"r": {"items": [{"id": at + i, "p": {"q": [1, 2]}} for i in range(2)] if at < 4 else []}}).encode()
            self.send_response(500 if "fail" in self.path else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_web_services(spark, service):
    df = rest.read_api(spark, f"{service}/x", json_path="r.items", pagination={"param": "at", "step": 2}, max_pages=9)
    assert sorted(df.columns) == ["id", "p_q_0", "p_q_1"] and sorted(r.id for r in df.collect()) == [0, 1, 2, 3]
    many = rest.read_api(spark, f"{service}/x", json_path="r.items", pagination={"param": "at", "step": 2, "stop_if_empty": False}, max_pages=2)
    assert sorted(r.id for r in many.collect()) == [0, 1, 2, 3]
    with pytest.raises(Exception):
        rest.read_api(spark, f"{service}/fail").count()
    assert opendata.soql({"a": (">", 1), "b": ("=", "o'x")}, 5) == "SELECT * WHERE a > 1 AND b = 'o''x' LIMIT 5"
    with pytest.raises(ValueError):
        opendata.soql({"a; drop": ("=", 1)})


def test_audit_log_keeps_one_row_an_id(spark, tmp_path):
    for kind in ("parquet", "csv", "json"):
        log = audit.AuditLog(spark, str(tmp_path / f"log.{kind}"))
        assert log.load().count() == 0
        log.log({"uuid": "u", "a": 'x,"y"'})
        log.save()
        log.log({"uuid": "u", "a": "late"})
        log.log_error("broken", {"k": 1})
        log.save()
        rows = {r.uuid: r for r in log.load().collect()}
        assert len(rows) == 2 and json.loads(rows["u"].record)["a"] == 'x,"y"' and log.load().count() == 2
        log.compact()
        assert {r.uuid: tuple(r) for r in log.load().collect()} == {k: tuple(v) for k, v in rows.items()} and log.vacuum() == 2 and log.vacuum() == 0 and len(log._commits()) == 1 and log.load().count() == 2
        log.log({"uuid": "u", "a": "later", "timestamp": "1900-01-01"})  # another clock: the first save stays
        log.save()
        assert json.loads(log.load().where("uuid = 'u'").first().record)["a"] == 'x,"y"'
    with pytest.raises(ValueError):
        audit.AuditLog(spark, "x", "xml")


def test_policy_of_a_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.co", "x y", 5.0), (2, "c@d.org", "z", 6.0)], "key int, mail string, note string, age double")
    made = policy.get_or_create(df, str(tmp_path / "p" / "policy.yaml"))
    by = {f["field_name"]: f for f in policy.load(str(tmp_path / "p" / "policy.yaml"))["fields"]}
    assert by["mail"]["privacy_level"] == "high" and by["age"]["security"] == "masked" and by["note"]["privacy_level"] == "low"
    assert by["key"]["rules"] == ["no_nulls", "positive_values", "enumerated_values"] and made["compliance"]["risk_level"] == "low"
    for name, level in (("address_label", "high"), ("language", "medium"), ("nombre_entidad", "high"), ("distance", "low")):
        assert policy.privacy_level(name) == level
    issues = policy.validate_compliance({"fields": {"a": {"sensitive": True, "required": True}}})
    assert len(issues) == 3
    assert policy.rule_report(df, made).where("not ok").count() == 0
    odd = spark.createDataFrame([(1, "a<b", "x", 5.0)], df.schema)
    assert [r.rule for r in policy.rule_report(odd, made).where("not ok").collect()] == ["plain_text"]


def test_engines_run_and_scores_do_not_fall(spark):
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 5 == 0 else float(np.exp(rng.normal() * 2)), None if i % 4 == 0 else f"v{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x double, s string")
    engine = remediate.Remediator(max_epochs=3)
    before = metrics.column_scores(df, {n: (logical_types(df)[n], F.col(n)) for n in df.columns})
    done, after = engine.run(df)
    assert done.columns == df.columns and done.count() == 200 and after["x"] > before["x"] and done.where("x is null").isEmpty()
    p = {"fields": [{"field_name": "x", "type": "float", "rules": ["no_nulls"]}, {"field_name": "s", "type": "string", "security": "masked"}], "primary_key": "k", "disaggregation_dimension": "s", "fill_values": {"s": "none"}, "relational_rules": [{"rule": ">", "fields": ["k", "x"]}]}
    registry = metrics.Registry()
    registry.register_field_metric("largest", lambda f, c: F.max(c.cast("string")))
    registry.register_pipeline_metric("phases", lambda m, report: len(report))
    report = monitor.Monitor(df, p, registry, 50.0).report()
    assert report["custom_pipeline_measures"]["phases"] >= 5 and report["cleaning"]["impact"]["s"] == 25.0 and "custom_largest" in report["ingestion"]["field_metrics"]["x"]
    with pytest.raises(ValueError):
        monitor.Monitor(df, p).evaluate_phase("other")
    found = improve.Improver(report["ingestion"]["field_metrics"], p, spark.createDataFrame([({"a": float(i)}, 2.0 * i + 1) for i in range(5)], improve.HISTORY))
    assert found.predict({"a": 10}) == pytest.approx(21) and found.recommendations(df)["global"] and all(r.potential_score >= r.current_score for r in found.chart(spark).collect())


def test_metrics_that_fail_leave_the_others_alone(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, s string")
    registry = metrics.Registry()

    def broken(f, c):
        raise KeyError("no")

    for name, func in (("good", lambda f, c: F.max(c)), ("raises", broken), ("unresolved", lambda f, c: F.max("nothing")), ("fails", lambda f, c: F.max(F.raise_error(F.lit("no"))))):
        registry.register_field_metric(name, func)
    registry.register_pipeline_metric("bad", broken)
    registry.register_pipeline_metric("fine", lambda m, r: 7)
    p = {"fields": [{"field_name": "x", "type": "float"}]}
    report = monitor.Monitor(df, p, registry).report()
    own = report["ingestion"]["field_metrics"]["x"]
    assert [own[f"custom_{n}"] for n in ("good", "raises", "unresolved", "fails")] == [2.0, None, None, None] and own["mean"] == 1.5
    assert report["custom_pipeline_measures"] == {"bad": None, "fine": 7}
    profiler = profile.Profiler()
    profiler.register("float", "top", F.max)
    profiler.register("float", "bad", lambda c: F.max("nothing"))
    got = {(r.field, r.metric): r.value for r in profiler.report(df).collect()}
    assert got["x", "top"] == 2.0 and got["x", "bad"] is None and got["s", "unique_values"] == 2
    parts = {(r.field, r.metric): r.part for r in monitor.Monitor(df, p, registry).explain_scores().collect()}
    assert parts["x", "mean"] == "base" and parts["x", "custom_good"] == "custom" and parts["x", "field_quality_score"] == "score"


def test_one_outlier_leaves_the_ranges_even(spark):
    rows = [(i, float(i % 977), f"2020-01-01 00:{i % 60:02}:{i // 60 % 60:02}") for i in range(3000)] + [(3000, 1e15, "1970-01-01 00:00:00"), (3001, None, None)]
    df = spark.createDataFrame(rows, "i int, x double, t string").withColumn("t", F.col("t").cast("timestamp"))
    per = df.where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    sizes = [r["count"] for r in profile.dealt(per, "x").groupBy("part").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * sum(sizes) / len(sizes)
    a = profile.temporal(df, "t").first()
    assert a.median_gap == 1.0 and a.max_gap > 1e9
    weighted = spark.createDataFrame([(0, 0.0, 100), (0, 5.0, 3), (0, 9.0, 2), (1, 1.0, 2), (1, 3.0, 2), (2, None, 4)], "i int, x double, n long")
    assert profile.quantiles_by(weighted, [0.5, 1.0]) == {0: [0.0, 9.0], 1: [2.0, 3.0]}
    assert profile.quantiles_by(weighted, {1: [0.0], 0: [0.99]}) == {1: [1.0], 0: [pytest.approx(8.84)]}
    v = sorted(r[1] for r in rows if r[1] is not None)
    want = (2 * sum((i + 1) * x for i, x in enumerate(v)) - (len(v) + 1) * sum(v)) / (len(v) * sum(v))
    assert profile.gini(df, "x").first().gini == pytest.approx(want)


def test_modes_fill_in_the_type_of_the_column(spark):
    df = spark.createDataFrame([(1, 2, 1.5, True, "a"), (2, 2, 1.5, True, "a"), (3, None, None, None, None)], "i int, n long, x double, b boolean, s string")
    done = X.transformed(df, {c: [X.impute_mode] for c in "nxbs"})
    assert done.schema == df.schema or [f.dataType for f in done.schema] == [f.dataType for f in df.schema]
    assert tuple(done.where("i = 3").first()) == (3, 2, 1.5, True, "a")


def test_text_is_cleaned_in_full(spark):
    rows = ["No Definido", "definido", "SIN DESCRIPCION", "no aplica", "Bien :-) ;( x", "a,b-c. d", "El Camión", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    assert out(df, X.text_cleaner(["el"])) == ["no definido", "no definido", "sin descripcion", "no aplica", "bien x", "abc d", "camion", None]
    assert out(df, X.text_cleaner(["el"], True))[5] == "abc. d"


def test_json_text_at_any_depth_and_its_errors(spark):
    rows = [('{"a": {"b": "{\\"c\\": [1, 2]}"}, "n": "12"}', "x"), ("{broken", "y"), (None, "z")]
    df = spark.createDataFrame(rows, "j string, k string")
    logged = flatten.flatten(df, json_text=True, errors="log")
    assert sorted(logged.columns) == ["j_a_b_c_0", "j_a_b_c_1", "j_error", "j_n", "k"] and dict(logged.dtypes)["j_n"] == "bigint"
    assert [(r.j_a_b_c_1, r.j_error) for r in logged.orderBy("k").collect()] == [(2, None), (None, "{broken"), (None, None)]
    assert flatten.flatten(df, json_text=True, errors="skip").count() == 2
    with pytest.raises(Exception):
        flatten.flatten(df, json_text=True, errors="raise").collect()
    with pytest.raises(ValueError):
        flatten.flatten(df, json_text=True, errors="other")


def test_loaders_tell_what_they_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    own = loader.loader(spark, "csv")
    found = own.load(path=str(tmp_path / "a.csv"))
    assert found.columns == ["k", "v"] and own.observed() is None
    assert len(found.collect()) == 2 and own.row_count(observed=True) == 2 and own.observed() == 2 and own.metadata["row_count"] == 2
    other = loader.loader(spark, "csv")
    other.load(path=str(tmp_path / "a.csv"))
    assert other.row_count() == 2
    assert own.metadata["status"] == "success" and own.metadata["path"].endswith("a.csv") and own.mismatches({"fields": {"k": {"type": "string"}}}) == {"k": {"expected": "string", "actual": "integer"}}
    with pytest.raises(Exception):
        loader.loader(spark, "parquet").load(path=str(tmp_path / "none"))
    quiet = loader.loader(spark, "parquet", "empty")
    assert quiet.load(path=str(tmp_path / "none")).count() == 0 and quiet.metadata["status"] == "failed" and quiet.metadata["error"]
    with pytest.raises(ValueError):
        loader.loader(spark, "fax")


def test_csv_comes_from_the_web(spark):
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'k,v\n1,"a\nb"\n2,c\n'.replace(b'"a\nb"', b"a"))

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = files.read_csv(spark, f"http://127.0.0.1:{server.server_port}/a.csv")
    server.shutdown()
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a"), (2, "c")]


def test_two_writers_a_reader_and_a_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    seen, failed = [], []

    def write(who):
        try:
            own = audit.AuditLog(spark, path)
            for i in range(6):
                own.log({"uuid": f"{who}{i}"})
                own.save()
        except Exception as error:  # told by the test
            failed.append(error)

    def compact():
        try:
            for _ in range(4):
                audit.AuditLog(spark, path).compact()
                seen.append(audit.AuditLog(spark, path).load().count())
        except Exception as error:
            failed.append(error)

    tasks = [threading.Thread(target=write, args=("a",)), threading.Thread(target=write, args=("b",)), threading.Thread(target=compact)]
    for t in tasks:
        t.start()
    for t in tasks:
        t.join()
    own = audit.AuditLog(spark, path)
    assert not failed and seen == sorted(seen) and own.load().count() == own.load().select("uuid").distinct().count() == 12
    # data without a commit, as a failed job leaves it, isn't seen
    spark.createDataFrame([("lost",) + (None,) * 7], audit.STORED).write.parquet(f"{path}/data/half")
    assert own.load().count() == 12 and own.compact().load().count() == 12
    own.append(spark.range(3).selectExpr("concat('r', id) AS uuid", "id"), status="new")
    assert own.load().where("status = 'new'").count() == 3


@pytest.fixture
def asked(spark):
    """An open-data service of 50 rows, and the queries it was asked."""
    rows = [{"id": str(i), "name": None if i % 7 == 0 else f"n{i % 5}", "ok": i % 2 == 0, "at": f"2024-01-{i % 28 + 1:02d}T00:00:00.000", "place": {"x": i}} for i in range(50)]
    table = spark.createDataFrame([(float(r["id"]), r["name"], r["ok"], r["at"], i) for i, r in enumerate(rows)], "id double, name string, ok boolean, at string, row long")
    queries = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            if url.path.startswith("/api/views"):
                kinds = {"id": "number", "name": "text", "ok": "checkbox", "at": "calendar_date", "place": "point"}
                body = {"columns": [{"fieldName": n, "dataTypeName": k} for n, k in kinds.items()]}
            else:
                query = parse_qs(url.query)["$query"][0]
                queries.append(query)
                rest_of = query.split(" AS n" if "count(" in query else "*", 1)[1]
                found = spark.sql("SELECT row FROM {t}" + rest_of.replace(":id", "row"), t=table).collect()
                body = [rows[r.row] for r in found] if "count(" not in query else [{"n": str(len(found))}]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", queries
    server.shutdown()


def test_filters_are_pushed_to_the_service(spark, asked):
    url, queries = asked
    df = opendata.read_socrata(spark, url, "ab", limit=None, page=10, stretch=25)
    assert df.dtypes == [("id", "double"), ("name", "string"), ("ok", "boolean"), ("at", "timestamp_ntz"), ("place", "string")]
    whole = df.collect()
    assert len(whole) == 50 and json.loads(whole[3].place) == {"x": 3} and whole[3].at.day == 4
    assert len(queries) == 1 + 6 and all("WHERE" not in q for q in queries)  # one count, and each page once: 25 rows are 3 pages
    assert opendata.read_socrata(spark, url, "ab", limit=None, page=10, stretch=5, tasks=2).rdd.getNumPartitions() == 2
    cases = {
        "id > 20 AND ok": "id > 20.0",
        "name = 'n1'": "name = 'n1'",
        "name IN ('n1', 'n2')": "name IN ('n1', 'n2')",
        "name IS NULL": "name IS NULL",
        "name LIKE 'n%'": "name LIKE 'n%'",
        "name LIKE '%1'": "name LIKE '%1'",
        "NOT name = 'n1'": "NOT (name = 'n1')",
        "id <= 5": "id <= 5.0",
        "at >= TIMESTAMP_NTZ'2024-01-20 00:00:00'": None,
    }
    for condition, text in cases.items():
        queries.clear()
        found = df.where(condition).collect()
        assert sorted(r.id for r in found) == sorted(r.id for r in spark.createDataFrame(whole, df.schema).where(condition).collect()), condition
        assert text is None or (all(text in q for q in queries) and queries), (condition, queries)
    queries.clear()
    assert df.where("id % 3 = 1 AND id < 10").count() == 3 and all("id < 10.0" in q and "%" not in q for q in queries)  # what the service can't take is left to Spark
    queries.clear()
    some = opendata.read_socrata(spark, url, "ab", {"id": (">=", 10)}, limit=20).where("id < 15")  # a limit counts rows before where()
    assert sorted(r.id for r in some.collect()) == [10, 11, 12, 13, 14] and all("id >= 10" in q and "id <" not in q for q in queries)


def test_each_page_is_fetched_once(spark):
    asked_for = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            at = int(parse_qs(urlparse(self.path).query)["at"][0])
            asked_for.append(at)
            again = at == 1 and asked_for.count(1) == 1
            self.send_response(503 if again else 200)
            self.end_headers()
            self.wfile.write(json.dumps([{"id": at, "more": {"k": [at, at]}}] if at < 3 else []).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = rest.read_api(spark, f"http://127.0.0.1:{server.server_port}/", pagination={"param": "at", "step": 1}, wait=0.01)
    assert sorted(r.id for r in df.collect()) == [0, 1, 2] and df.count() == 3 and df.columns == ["id", "more_k_0", "more_k_1"]
    server.shutdown()
    assert asked_for == [0, 1, 1, 2, 3]  # a page that failed is asked for again, the others once


def test_a_stream_goes_on_with_its_baseline(spark, tmp_path):
    """Stopped after two batches and started anew, it raises the alerts of one that was never stopped."""
    rows = [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, None], [None, None, None, 8.0], [9.0, 10.0, 11.0, 12.0]]
    policy_ = {"fields": [{"field_name": "x", "type": "float"}]}

    def run(name, stops):
        src, seen = tmp_path / name / "in", []
        spark.createDataFrame([], "x double").write.parquet(str(src))
        query = None
        for i, own in enumerate(rows):
            if query is None:
                query = live.watch(spark.readStream.schema("x double").parquet(str(src)), policy_, str(tmp_path / name / "ck"), lambda n, m, drift: seen.append((n, drift and round(drift, 6))), threshold=5.0)
            spark.createDataFrame([(x,) for x in own], "x double").coalesce(1).write.mode("append").parquet(str(src))
            query.processAllAvailable()
            if i in stops:
                query.stop()
                query = None
        if query:
            query.stop()
        return [d for _, d in seen]

    once, often = run("once", ()), run("often", (1, 2))
    assert once == often and len(once) >= 3 and once[0] is None and once[-1] is not None
    known = live.Baselines(spark, str(tmp_path / "base"))
    for n in (1, 2, 2, 5):
        known.put(n, {"score": n})
    assert known.before(2) == {"score": 1} and known.before(5) == {"score": 2} and known.before(9) == {"score": 5} and known.before(1) is None


def test_quantiles_of_all_columns_come_from_ranges(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(50)), rng.randrange(10**6), None if i % 3 else rng.random(), "7" if i % 2 else str(rng.randrange(9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b long, c double, d string")
    per = profile.value_counts(df, [F.col(c) for c in df.columns]).withColumn("x", profile.as_number())
    found = profile.quantiles_by(per, [0.0, 0.1, 0.25, 0.5, 0.75, 1.0])

    for i, c in enumerate(df.columns):
        values = np.array([float(r[i]) for r in rows if r[i] is not None])
        assert found[i] == pytest.approx(np.quantile(values, [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]).tolist()), c
    ranged = per.where("x is not null").repartitionByRange(16, "i", "x").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in ranged.collect()) < per.count() / 8  # no task has a column
    assert profile.quantiles_by(per.where("false"), [0.5]) == {}
    kinds, quartiles = profile.by_value(df, {c: F.col(c) for c in df.columns}, [True] * 4)
    assert kinds == {c: len({r[i] for r in rows if r[i] is not None}) for i, c in enumerate(df.columns)} and set(quartiles) == set(df.columns)


def test_states_add_up(spark):
    rng = random.Random(4)
    rows = [(i % 7, None if i % 11 == 0 else rng.gauss(100, 15) ** (1 + i % 2), i % 3 == 0, None if i % 5 == 0 else f"t{i % 400}") for i in range(4000)]
    df = spark.createDataFrame(rows, "day int, x double, ok boolean, t string")
    apart = states.merge(states.build(df.where("day < 3"), {"day": F.col("day")}).unionByName(states.build(df.where("day >= 3"), {"day": F.col("day")})))
    whole = {(r.field, r.metric): r.value for r in states.metrics(states.build(df.drop("day"))).collect()}
    merged = {(r.field, r.metric): r.value for r in states.metrics(apart).collect()}
    assert set(whole) == set(merged)
    exact = {(r.field, r.metric): r.value for r in profile.numeric(df, ["x"]).collect()}
    for (n, m), v in merged.items():
        if not m.startswith("approx"):
            assert v == pytest.approx(whole[n, m], rel=1e-9), (n, m)
            assert (n, m) not in exact or v == pytest.approx(exact[n, m], rel=1e-9), (n, m)
    assert merged["t", "approx_unique"] == pytest.approx(320, rel=5 * states.ERRORS["approx_unique"])
    values = sorted(r[1] for r in rows if r[1] is not None)
    for p, m in ((0.25, "approx_p25"), (0.5, "approx_median"), (0.75, "approx_p75")):
        assert abs(sum(v <= merged["x", m] for v in values) / len(values) - p) < 3 * states.ERRORS["rank"]
    by_day = states.build(df, {"day": F.col("day")})
    again = states.merge(states.merge(by_day.where("day < 5")).unionByName(states.merge(by_day.where("day >= 5"))))  # in any order
    assert {(r.field, r.metric): r.value for r in states.metrics(again).where("metric = 'kurtosis'").collect()}["x", "kurtosis"] == pytest.approx(exact["x", "kurtosis"], rel=1e-9)
    assert states.metrics(states.merge(by_day.where("false"))).count() == 0


def test_a_model_is_fitted_by_aggregation(spark):
    rows = [({"a": float(i), "b": float(i * i % 7)} if i % 4 else {"a": float(i)}, 3.0 + 2.0 * i - 0.5 * (i * i % 7 if i % 4 else 0)) for i in range(60)] + [({"a": 1.0}, None)]
    own = improve.model(spark.createDataFrame(rows, improve.HISTORY).repartition(5))
    assert own.predict({"a": 10.0, "b": 4.0}) == pytest.approx(21.0) and own.predict({}) == pytest.approx(3.0)
    twins = improve.model(spark.createDataFrame([({"a": float(i), "b": float(i)}, 2.0 * i) for i in range(9)], improve.HISTORY))  # features that depend on each other
    assert twins.weights == pytest.approx((1.0, 1.0)) and twins.predict({"a": 4.0, "b": 4.0}) == pytest.approx(8.0)
    assert improve.model(spark.createDataFrame([], improve.HISTORY)) is None and improve.Improver({}, {}).predict({"a": 1}) is None


def test_workbooks_over_partitions(spark):
    df = spark.createDataFrame([(i, f"n{i}" if i % 3 else None, i / 4, i % 2 == 0) for i in range(12_000)], "k long, name string, x double, even boolean")
    back = files.excel_tables(files.to_excel(df.repartition(3)))
    assert back.dtypes == [("k", "double"), ("name", "string"), ("x", "double"), ("even", "boolean")]
    assert back.exceptAll(df.select(F.col("k").cast("double").alias("k"), "name", "x", "even")).isEmpty() and back.count() == 12_000
    with pytest.raises(ValueError):
        files.excel_tables(files.to_excel(df.limit(0)))


def merged_by_brute_force(values):
    from difflib import SequenceMatcher

    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    values = sorted(values, key=str.encode)
    pairs = [ratio(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    bound, into = np.percentile(pairs, 75) if pairs else 1.0, {}
    for i, v in enumerate(values):
        if v not in into:
            into |= {w: v for w in values[i + 1 :] if ratio(v, w) >= bound}
    return into


@pytest.mark.parametrize("seed", range(4))
def test_similar_labels_against_brute_force(spark, seed):
    rng = random.Random(seed)
    kinds = ["ab", "abcde", "abcdefghij klm", "é\U0001F600xy"][seed]
    values = {"".join(rng.choice(kinds) for _ in range(rng.randrange(0, 12))) for _ in range(60)} | ({"long " * 60, "long " * 59 + "lang "} if seed == 1 else set())
    labels = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    want = merged_by_brute_force(values)
    assert len(want) > 5
    for block, batch in ((500, 200), (7, 3), (16, 1)):
        assert {r.old: r.new for r in categories.similar(labels, block, batch).collect()} == want


def test_similar_labels_of_few_or_many(spark):
    for values in ([], ["one"], ["one", "two"]):
        assert {r.old: r.new for r in categories.similar(spark.createDataFrame([(v,) for v in values], "v string")).collect()} == merged_by_brute_force(values)
    many = spark.range(1_200).select(F.format_string("brand %05d", "id").alias("x"))  # more than one block, and no bound on their number
    done = X.merge_similar(many.union(many.limit(5)), "x")
    assert done.count() == 1_205 and done.distinct().count() < 1_200
    column_ = spark.createDataFrame([(None,), ("None",), ("Nine",), ("x",)], "x string")
    assert sorted(r.x for r in X.merge_similar(column_, "x").collect()) == ["Nine", "Nine", "Nine", "x"]


def test_stream_is_profiled_by_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(float(i), "2020-01-01") for i in range(20)], "x double, t string").write.parquet(str(src))
    stream = spark.readStream.schema("x double, t string").parquet(str(src))
    seen = []
    query = live.watch(stream, {"fields": [{"field_name": "x", "type": "float"}]}, str(tmp_path / "ck"), lambda n, m, drift: seen.append((n, drift)))
    query.processAllAvailable()
    query.stop()
    assert seen == [(0, None)]
    assert live.windowed(spark.read.parquet(str(src)), "t", ["x"]).first().rows == 20


def test_masks_and_codes(spark):
    df = column(spark, ["secret", None], "string")
    assert [r[0] for r in df.select(text.encoded(F.col("x"))).collect()] == ["c2VjcmV0", None]
    key = F.lit("0123456789abcdef")
    assert df.select(F.aes_decrypt(F.unbase64(text.encrypted(F.col("x"), key)), key).cast("string")).first()[0] == "secret"


def test_the_iterative_query_runs_the_default_epochs(spark, sf, monkeypatch):
    from plumbline import queries

    epochs = []
    monkeypatch.setattr(remediate.Remediator, "run", lambda self, df: (epochs.append(self.max_epochs), (df, None))[1])
    queries.QUERIES["iterative_remediation"](spark, sf)
    assert epochs == [remediate.Remediator().max_epochs] == [5]
