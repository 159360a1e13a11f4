import json
from datetime import date, timedelta

import pytest

import __spark_entry__ as entry
from tamarack.functions.features import DIM, vectorize
from tamarack.sources.payloads import parse_payloads, read_lookup, read_payloads, read_references, split_rejects

# The vector of a payload without any field, and the one known payload with its vector.
DEFAULTS = [0, 0, 0, 0, 0, -1, -1, 0, 0, 0, 0, 1, 0.5, 0]


def payload(**changes):
    p = {
        "id": "p1",
        "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
        "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["M3", "M16", "M16"]},
        "merchant": {"id": "M16", "mcc": "5411", "avg_amount": 60.25},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.2331036248},
        "last_transaction": None,
    }
    for path, value in changes.items():
        *at, leaf = path.split("__")
        where = p
        for k in at:
            where = where[k]
        where[leaf] = value
    return p


def vectors(spark, *payloads):
    rows = [(k, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)]
    good, _ = split_rejects(parse_payloads(spark.createDataFrame(rows, "k long, body string")))
    return [[float(x) for x in r.vector] for r in vectorize(good).orderBy("k").collect()]


def test_known_vector(spark):
    expected = [0.004112, 0.166667, 0.05, 0.782609, 0.333333, -1, -1, 0.029233, 0.15, 0, 1, 0, 0.15, 0.006025]
    assert vectors(spark, payload())[0] == pytest.approx(expected, abs=1e-6)


def test_edge_values(spark):
    last = {"timestamp": "2026-03-11T18:15:53Z", "km_from_current": 250.0}
    cases = [
        (payload(customer__avg_amount=0.0), {2: 0}),
        (payload(customer__avg_amount=-3.0), {2: 0}),
        (payload(transaction__amount=25000.0), {0: 1, 2: 1}),
        (payload(transaction__amount=-5.0), {0: 0, 2: 0}),
        (payload(transaction__installments=24), {1: 1}),
        (payload(merchant__mcc="541"), {12: 0.5}),
        (payload(merchant__mcc="54110"), {12: 0.5}),
        (payload(merchant__mcc=None), {12: 0.5}),
        (payload(merchant__mcc="7995"), {12: 0.85}),
        (payload(merchant__id=None), {11: 1}),
        (payload(merchant__id=""), {11: 1}),
        (payload(merchant__id="M9"), {11: 1}),
        (payload(customer__known_merchants=[]), {11: 1}),
        (payload(customer__known_merchants=None), {11: 1}),
        (payload(last_transaction=last), {5: 30 / 1440, 6: 0.25}),
        (payload(last_transaction=last | {"timestamp": "2026-03-11T19:00:00Z"}), {5: 0}),
        (payload(last_transaction=last | {"timestamp": "2026-02-11T19:00:00Z", "km_from_current": 5000.0}), {5: 1, 6: 1}),
        (payload(transaction__requested_at="2024-02-29T23:59:59Z"), {3: 1, 4: 3 / 6}),
        (payload(terminal__is_online=True, terminal__card_present=False), {9: 1, 10: 0}),
        (payload(customer__tx_count_24h=40), {8: 1}),
    ]
    for (_, wanted), got in zip(cases, vectors(spark, *(c[0] for c in cases)), strict=True):
        assert len(got) == DIM
        for k, x in wanted.items():
            assert got[k] == pytest.approx(x, abs=1e-6), (k, got)


def test_weekdays_across_leap_and_century_years(spark):
    days = [date(y, 2, 27) + timedelta(k) for y in (1900, 2000, 2023, 2024) for k in range(9)]
    got = vectors(spark, *(payload(transaction__requested_at=f"{d}T00:00:00Z") for d in days))
    assert [round(v[4] * 6) for v in got] == [d.weekday() for d in days]


def test_missing_objects_give_defaults(spark):
    assert vectors(spark, "{}")[0] == pytest.approx(DEFAULTS)


def test_malformed_text_is_rejected(spark):
    rows = [(1, json.dumps(payload())), (2, '{"transaction": {"amo'), (3, "no json"), (4, None)]
    good, bad = split_rejects(parse_payloads(spark.createDataFrame(rows, "k long, body string")))
    assert [r.k for r in good.collect()] == [1]
    assert sorted(r.body or "" for r in bad.collect()) == ["", "no json", '{"transaction": {"amo']


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([payload(), payload(id="p2")]))
    assert read_payloads(spark, str(tmp_path / "p.json"), multi_line=True).count() == 2
    (tmp_path / "r.json").write_text(json.dumps([{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [0.1] * 14, "label": "other"}]))
    refs = read_references(spark, str(tmp_path / "r.json"))
    assert [(r.label, len(r.vector)) for r in refs.orderBy("ref_id").collect()] == [(1, 14), (0, 14)]
    (tmp_path / "bad.json").write_text(json.dumps([{"vector": [0.5] * 3, "label": "fraud"}]))
    with pytest.raises(Exception, match="14 expected"):
        read_references(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "l.json").write_text('{"5411": 0.15, "9": 1}')
    assert read_lookup(spark, str(tmp_path / "l.json")) == {"5411": 0.15, "9": 1.0}


def test_filters_and_columns_reach_the_scan_of_a_registered_query(spark):
    plan = entry.queries()["latency_histogram"](spark, "/root/testdata/sf0.001").where("bucket = 2")
    assert "ReadSchema: struct<value:double>" in plan._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # else the schema is cut
    found = entry.queries()["knn_vote"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in found
    assert "PushedFilters: [IsNotNull(embedding)" in found
