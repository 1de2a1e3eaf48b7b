"""Operators on small fixtures."""

from __future__ import annotations

import json
import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesmill.functions import labelset as ls
from seriesmill.operators import blocks, catalog, delivery, relabel, replicas, select, staleness, status, wal
from seriesmill.operators.matchers import BadRegex, Matcher, NoPositiveMatchers, query_status
from seriesmill.operators.relabel import Rule
from seriesmill.sources import frames, limits, remote_write, segments, text
from seriesmill.streaming import stateful


def series(spark, *sets):
    rows = [(k, s.get("__name__", ""), s) for k, s in enumerate(sets)]
    return spark.createDataFrame(rows, "series_id long, metric_name string, labels map<string,string>").withColumn("ls_key", ls.canonical(F.col("labels")))


FIVE = ({"lol": "kek"}, {"che": "bureck", "lol": "kek"}, {"lol": "kek", "zhe": "bureck"}, {"foo": "bar"}, {"foo": "baz"})


class TestMatchers:
    def test_match_in_label_order(self, spark):
        got = select.match_series(series(spark, *FIVE), [Matcher("lol", "=", "kek")]).orderBy("ls_key").collect()
        assert [r.series_id for r in got] == [1, 0, 2]

    def test_statuses(self):
        assert query_status(0, [("kek", "!=", "lol")]) == "NoPositiveMatchers"
        assert query_status(0, [("kek", "=", "lol")]) == "NoMatch"
        assert query_status(0, [("kek", "=~", '.["')]) == "RegexpError"
        assert query_status(3, [("lol", "=", "kek")]) == "Match"

    def test_errors(self, spark):
        with pytest.raises(BadRegex):
            Matcher("a", "=~", "(")
        for m in (Matcher("a", "!=", "x"), Matcher("a", "=", ""), Matcher("a", "=~", ".*")):
            with pytest.raises(NoPositiveMatchers):
                select.match_series(series(spark, *FIVE), [m])

    @pytest.mark.parametrize(("op", "value"), [("=", ""), ("!=", "bar"), ("=~", "ba."), ("=~", "ba"), ("!~", "ba[rx]"), ("=~", "|baz"), ("=", "bar")])
    def test_columns_agree_with_python(self, spark, op, value):
        m = Matcher("foo", op, value)
        got = {r.series_id for r in select.match_series(series(spark, *FIVE), [m], need_positive=False).collect()}
        assert got == {k for k, s in enumerate(FIVE) if m.accepts(s.get("foo", ""))}

    @pytest.mark.parametrize("pattern", ["(?=a)", "a(?!b)", r"(a)\1", "a++", "(?>a)", "(?<=a)b", "[", "a**", "x{1001}", r"\y"])
    def test_what_re2_lacks_is_refused(self, pattern):
        with pytest.raises(BadRegex):
            Matcher("a", "=~", pattern)

    @pytest.mark.parametrize(("pattern", "value", "found"), [(r"\pL+", "é", True), (r"\p{Greek}", "λ", True), (r"[[:alpha:]]+", "ab", True), ("[a&&b]+", "&b", True), ("[[x]+", "[x", True), ("(?P<one_two>a)b", "ab", True), (r"\Qa.b\E", "a.b", True), (r"\Qa.b\E", "axb", False), (r"\s", "\x0b", False), (r"[^\S]", " ", True), (r"a{,2}", "a{,2}", True), (r"\x{e9}", "é", True)])
    def test_patterns_are_re2s(self, spark, pattern, value, found):
        m = Matcher("foo", "=~", pattern)
        assert m.accepts(value) == found
        assert select.match_series(series(spark, {"foo": value}), [m], need_positive=False).count() == found

    def test_a_newline_is_part_of_the_value(self, spark):
        got = series(spark, {"a": "x\n"}, {"a": "x"})
        assert select.match_series(got, [Matcher("a", "=~", "x")]).count() == 1
        assert select.match_series(got, [Matcher("a", "=~", "x.")]).count() == 1


def test_ordered_by_labels_and_time(spark):
    rows = [("b:1;", 2, 0.0), ("a:2;", 9, 0.0), ("b:1;", 1, 0.0), ("a:1;", 5, 0.0), ("a:2;", 3, 0.0)]
    got = select.ordered(spark.createDataFrame(rows, "ls_key string, ts_ms long, value double").repartition(4)).collect()
    assert [tuple(r)[:2] for r in got] == sorted((k, t) for k, t, _ in rows)


class TestLabels:
    def test_names_and_values(self, spark):
        s = series(spark, *FIVE)
        assert [r.name for r in select.label_names(s).collect()] == ["che", "foo", "lol", "zhe"]
        assert [r.name for r in select.label_names(s, [Matcher("lol", "=~", ".+")]).collect()] == ["che", "lol", "zhe"]
        assert [r.value for r in select.label_values(s, "foo").collect()] == ["bar", "baz"]

    @settings(max_examples=15, deadline=None)
    @given(st.dictionaries(st.text("abcxyz", min_size=1, max_size=4), st.text("klmn", min_size=1, max_size=4), max_size=5), st.dictionaries(st.text("abcxyz", min_size=1, max_size=4), st.text("klmn", min_size=1, max_size=4), max_size=5))
    def test_algebra(self, spark, a, b):
        row = spark.createDataFrame([(a, b)], "a map<string,string>, b map<string,string>").select(ls.merge(F.col("a"), F.col("b")).alias("m"), ls.without(F.col("a"), list(b)).alias("w"), ls.only(F.col("a"), list(b)).alias("o"), ls.canonical(F.col("a")).alias("c"), ls.from_json(ls.to_json(F.col("a"))).alias("j"), ls.length(F.col("a")).alias("n")).first()
        assert row.m == a | b
        assert row.w == {k: v for k, v in a.items() if k not in b}
        assert row.o == {k: v for k, v in a.items() if k in b}
        assert row.c == "".join(f"{k}:{v};" for k, v in sorted(a.items()))
        assert row.j == a and row.n == len(a)

    @settings(max_examples=15, deadline=None)
    @given(st.dictionaries(st.text("ab \"'\\\\:#é", min_size=1, max_size=4), st.text("kl \"'\\\\:#\n{,", max_size=5), max_size=4))
    def test_yaml_round_trip(self, spark, m):
        text = ls.to_yaml(F.col("m"))
        assert spark.createDataFrame([(m,)], "m map<string,string>").select(ls.from_yaml(text).alias("y")).first().y == m

    @pytest.mark.parametrize(("text", "labels"), [("a: 1\nb: 'it''s'\n", {"a": "1", "b": "it's"}), ("---\n# note\nhost: a.b:80  # port\nempty:\n", {"host": "a.b:80", "empty": ""}), ("{}", {}), ("", {}), ("a: 1\na: 2", None), ("a", None), ("- a", None), ("a: [1]", None), ("'q r': \"x\\ty\"", {"q r": "x\ty"})])
    def test_yaml(self, spark, text, labels):
        assert spark.createDataFrame([(text,)], "t string").select(ls.from_yaml(F.col("t")).alias("y")).first().y == labels

    def test_postings(self, spark):
        got = {(r.name, r.value): r.ids for r in select.postings(series(spark, *FIVE)).collect()}
        assert got["lol", "kek"] == [0, 1, 2] and got["foo", "baz"] == [4]


STATUS = ({"job": "cron", "server": "localhost", "__name__": "php"}, {"job": "cron", "server": "127.0.0.1:8000", "__name__": "c++"}, {"job": "cro1", "ip": "127.0.0.1", "__name__": "nodejs"})


def test_head_status(spark):
    s = series(spark, *STATUS)
    samples = spark.createDataFrame([(0, 1, 1.0), (1, 3, 1.0), (2, 3, 1.0)], "series_id long, ts_ms long, value double")
    pairs = lambda df: {(r.name): r.n for r in df.collect()}
    assert pairs(status.values_by_label(s)) == {"__name__": 3, "job": 2, "server": 2, "ip": 1}
    assert pairs(status.bytes_by_label(s)) == {"server": 23, "__name__": 12, "job": 12, "ip": 9}
    assert pairs(status.series_by_metric(s)) == {"php": 1, "c++": 1, "nodejs": 1}
    assert status.series_by_pair(s).first()[:] == ("job", "cron", 2)
    assert status.totals(s, samples).first()[:] == (3, 8, 3, 1, 3)


class TestRelabel:
    @pytest.mark.parametrize(
        ("rule", "message"),
        [
            (Rule(action=""), "names no action"),
            (Rule(action="replace"), "has no target label"),
            (Rule(action="lowercase"), "has no target label"),
            (Rule(action="lowercase", target_label="${2}x"), "can't write"),
            (Rule(("a",), regex="(x+)/(y*)", replacement="$2", target_label="9$1"), "can't write"),
            (Rule(("a",), regex="(x+)/(y*)", replacement="$2", target_label="/$1"), "can't write"),
            (Rule(regex="(a)", replacement="-$1", action="labelmap"), "can't make names"),
            (Rule(action="hashmod", target_label="x"), "modulus"),
            (Rule(regex="(", action="drop"), "regex"),
        ],
    )
    def test_invalid(self, rule, message):
        with pytest.raises(ValueError, match=message.replace("$", r"\$")):
            rule.validate()

    def test_valid(self):
        Rule(("a",), regex="(x+)/(y*)", replacement="$2", target_label="${1}").validate()
        assert Rule.of({"action": "HashMod"}).action == "hashmod"

    @pytest.mark.parametrize(("label", "valid"), [("zone", True), ("_z9", True), ("9z", False), ("a-b", False), ("$1", True), ("${kind}", True), ("pre_$2_post", True), ("${1}${2}", True), ("a$", False), ("${", False), ("${}", False), ("a${b", False), ("", False), ("$1/x", False)])
    def test_targets(self, label, valid):
        assert bool(relabel.TARGET.fullmatch(label)) == valid

    def run(self, spark, labels, *rules):
        got = relabel.relabel(series(spark, labels), list(rules)).collect()
        return got[0].labels if got else None

    def test_replace(self, spark):
        rule = Rule(("path",), regex="/(\\w+)/(.+)", replacement="${1}:$2", target_label="$1")
        assert self.run(spark, {"path": "/disk/sda"}, rule) == {"path": "/disk/sda", "disk": "disk:sda"}
        assert self.run(spark, {"path": "disk"}, rule) == {"path": "disk"}

    def test_keep_drops_the_series(self, spark):
        assert self.run(spark, {"job": "abc"}, Rule(("job",), regex="abc", action="keep")) is not None
        assert self.run(spark, {"job": "abcd"}, Rule(("job",), regex="abc", action="keep")) is None

    def test_long_chains_plan_in_linear_time(self, spark):
        sizes = []
        for n in (10, 20, 50):
            rules = [Rule(("a", f"l{k}"), regex="(.*);(.*)", replacement="$1$2", target_label=f"l{k + 1}") for k in range(n)] + [Rule(("a",), regex="no.*", action="drop")]
            began = time.perf_counter()
            out = relabel.relabel(series(spark, {"a": "x", "l0": "y"}), rules)
            sizes.append(len(out._jdf.queryExecution().executedPlan().toString()))
            assert time.perf_counter() - began < 10
            assert out.first().labels[f"l{n}"] == "x" * n + "y"
        assert sizes[2] < 8 * sizes[0]

    def test_dropped(self, spark):
        s = series(spark, {"a": "x"}, {"a": "y"}, {"b": "x"})
        rules = [Rule(("a",), regex="x", action="drop"), Rule(regex="b", action="labeldrop")]
        assert [r.series_id for r in relabel.dropped_by(s, rules).orderBy("series_id").collect()] == [0, 2]
        assert relabel.dropped_count(s, rules).first()[:] == (2, 1)

    def test_a_series_without_labels_goes(self, spark):
        assert self.run(spark, {"job": "a"}, Rule(regex="job", action="labeldrop")) is None

    def test_named_group_and_dollar(self, spark):
        assert self.run(spark, {"a": "x1"}, Rule(("a",), regex="(?P<l>[a-z])(.)", replacement="$$${l}-$2", target_label="b")) == {"a": "x1", "b": "$x-1"}

    def test_labelmap_collision(self, spark):
        assert self.run(spark, {"a_x": "1", "b_x": "2"}, Rule(regex="(a|b)_x", replacement="y", action="labelmap")) == {"a_x": "1", "b_x": "2", "y": "2"}

    def test_target_labels(self, spark):
        df = series(spark, {"job": "abc", "exported_job": "old"})
        got = df.select(relabel.target_labels(F.col("labels"), {"job": "t", "zname": "z"}).alias("m"), relabel.target_labels(F.col("labels"), {"job": "t"}, honor=True).alias("h")).first()
        assert got.m == {"job": "t", "zname": "z", "exported_job": "old", "exported_exported_job": "abc"}
        assert got.h["job"] == "abc"

    def test_identity_needs_no_map(self):
        assert relabel.only_filters([Rule(action="keep"), Rule(action="dropequal")]) and not relabel.only_filters([Rule()])
        assert relabel.config_hash([Rule(("ab",))]) != relabel.config_hash([Rule(("a", "b"))])


PROMETHEUS = """# HELP disk_wait_seconds Waits for the disk, by share.
# \tTYPE disk_wait_seconds summary
disk_wait_seconds{share="0.5"} 3.5e-03
disk_wait_seconds{share="0.75",} 7.25e-03
disk_wait_seconds{ share="0.9", unit="sda"} 12.5e-03
# HELPING is no keyword
#
tide_level{Pier="7",dock="n"} 54321
# HELP bare
disk_wait_seconds { share = "1.0", unit = "sda" } 12.5e-03
disk_wait_seconds { share = "2.0" unit = "sda" } 12.5e-03
disk_wait_seconds_count 41
pier:boats:rate1h{x_y="z"}\t2
boats 17  \t987654
_hidden 5
quoted{text="say \\"no\\" or \\\\n"} 1
# HELP odd one\x00two
odd_byte{b="yz\x00"} 1
"""
OPEN = """# TYPE haul histogram
# UNIT haul_seconds seconds
haul_bucket{le="+Inf"} 3 # {trace="t-1"} 2
boats 17 456.789
crew_count 2 # {trace="t-2",deck="up"} 2 456.789
nets_total 8.5 1600000000.125 # {trace="t-3"} 6
# EOF
ignored 1
"""


class TestText:
    def parse(self, spark, body, **kw):
        payloads = spark.createDataFrame([(1, bytearray(body if isinstance(body, bytes) else body.encode()))], "payload_id long, body binary")
        lines = text.lines_of(payloads)
        return text.parse_samples(lines, **kw), text.parse_metadata(lines)

    def test_prometheus(self, spark):
        samples, meta = self.parse(spark, PROMETHEUS)
        got = samples.orderBy("line_no").collect()
        assert [r.error for r in got] == [None] * 12
        assert got[3].labels == {"__name__": "tide_level", "Pier": "7", "dock": "n"}
        assert got[4].labels == got[5].labels | {"share": "1.0"}
        assert (got[8].value, got[8].ts_ms) == (17.0, 987654)
        assert got[10].labels["text"] == 'say "no" or \\n' and got[11].labels["b"] == "yz\x00"
        assert [(r.metric_name, r.kind, r.text) for r in meta.orderBy("line_no").collect()] == [
            ("disk_wait_seconds", "help", "Waits for the disk, by share."),
            ("disk_wait_seconds", "type", "summary"),
            ("bare", "help", ""),
            ("odd", "help", "one\x00two"),
        ]

    def test_open_metrics(self, spark):
        samples, meta = self.parse(spark, OPEN, open_metrics=True)
        got = samples.orderBy("line_no").collect()
        assert [(r.error, r.value, r.ts_ms) for r in got] == [(None, 3.0, None), (None, 17.0, 456789), (None, 2.0, None), (None, 8.5, 1600000000125)]
        assert [r.kind for r in meta.orderBy("line_no").collect()] == ["type", "unit"]

    @pytest.mark.parametrize(("body", "code"), [(b"a{b='c'} 1\n", 1), (b'{b="c"} 1\n', 2), (b'a{b="\x80"} 1\n', 3), (b'a{b="c"} v\n', 4), (b'a{b="c"} 1 9223372036854775808\n', 5)])
    def test_errors(self, spark, body, code):
        samples, _ = self.parse(spark, b"fine 1\n" + body)
        assert text.payload_errors(samples).first()[:] == (1, 0, code)
        assert text.accepted(samples).count() == 0

    def test_long_values(self, spark):
        for value in ("x" * 65_536, '\\"' * 30_000, "\\\\" * 30_000, "}" * 65_536):
            samples, _ = self.parse(spark, f'a{{b="{value}",c="d"}} 1 5\nbad{{b="{value}}} 1\n')
            good, bad = samples.orderBy("line_no").collect()
            assert good.error is None and (good.value, good.ts_ms, good.labels["c"]) == (1.0, 5, "d")
            assert good.labels["b"] == value.replace('\\"', '"').replace("\\\\", "\\") and bad.error == 1
        samples, _ = self.parse(spark, "a{" + ",".join(f'l{k}="v"' for k in range(5000)) + "} 1\n" + "a " + " " * 50_000 + "\n")
        assert [r.error for r in samples.orderBy("line_no").collect()] == [None, 1]

    def test_empty(self, spark):
        samples, meta = self.parse(spark, "")
        assert samples.count() == 0 and meta.count() == 0


REQUEST = {
    "series": [{"labels": [{"name": "__name__", "value": "m"}, {"name": "cluster", "value": "cluster-0"}, {"name": "__replica__", "value": "r-1"}], "samples": [{"ts_ms": -5, "value": 1.5}, {"ts_ms": 1 << 40, "value": math.inf}]}],
    "metadata": [{"metric_name": "m", "type": 1, "help": "h", "unit": "s"}],
}


class TestRemoteWrite:
    def test_round_trip(self):
        assert remote_write.decode(remote_write.encode(REQUEST)) == REQUEST

    @settings(max_examples=40, deadline=None)
    @given(st.lists(st.tuples(st.lists(st.tuples(st.text(max_size=200), st.text(max_size=3)), max_size=3), st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False)), max_size=3)), max_size=4))
    def test_round_trips(self, given_series):
        request = {"series": [{"labels": [{"name": n, "value": v} for n, v in labels], "samples": [{"ts_ms": t, "value": x} for t, x in samples]} for labels, samples in given_series], "metadata": []}
        assert remote_write.decode(remote_write.encode(request)) == request

    @pytest.mark.parametrize(("limit", "error"), [({"name_length": 4}, "label name length"), ({"value_length": 2}, "label value length"), ({"labels": 2}, "labels per series"), ({"samples": 1}, "samples per batch")])
    def test_limits_while_decoding(self, spark, limit, error):
        payloads = spark.createDataFrame([(1, bytearray(remote_write.encode(REQUEST)))], "payload_id long, body binary")
        got = remote_write.decode_payloads(payloads, limits.Limits(**limit)).first()
        assert got.error == error and got.series == [] and got.metadata == []

    def test_requests_hold_what_they_should(self, spark):
        rows = spark.createDataFrame([({"a": str(k % 7)}, f"a:{k % 7};", k * 1000, float(k)) for k in range(500)], "labels map<string,string>, ls_key string, ts_ms long, value double")
        for given_count in (None, 3):
            got = remote_write.requests_of(rows, 40, 100_000, given_count)
            back = remote_write.samples_of(remote_write.decode_payloads(remote_write.encode_payloads(got)))
            assert sorted(r.value for r in back.collect()) == [float(k) for k in range(500)]
        assert remote_write.requests_of(rows.limit(0)).count() == 0

    def test_rows(self, spark):
        payloads = spark.createDataFrame([(1, bytearray(remote_write.encode(REQUEST))), (2, bytearray(b"\x05junk")), (3, None)], "payload_id long, body binary")
        got = remote_write.decode_payloads(payloads)
        assert {r.payload_id: r.error is None for r in got.collect()} == {1: True, 2: False, 3: True}
        assert [(r.ts_ms, r.value) for r in remote_write.samples_of(got).orderBy("ts_ms").collect()] == [(-5, 1.5), (1 << 40, math.inf)]
        assert {(r.kind, r.text) for r in remote_write.metadata_of(got).collect()} == {("help", "h"), ("type", "counter"), ("unit", "s")}
        assert remote_write.origin(got).where("payload_id = 1").first()[1:] == ("cluster-0", "r-1")

    def test_segments(self, spark, tmp_path):
        good = segments.write_segment(3, b"abc") + segments.write_segment(1, b"")
        (tmp_path / "a").write_bytes(good)
        (tmp_path / "b").write_bytes(good[:-1] + segments.write_segment(2, b"xyz")[:-1])
        got = segments.load(spark, str(tmp_path)).orderBy("path", "segment").collect()
        assert [(r.samples, bytes(r.payload), r.corrupted) for r in got[:2]] == [(3, b"abc", False), (1, b"", False)]
        assert got[-1].corrupted


def test_limits(spark):
    s = spark.createDataFrame([(1, {"abc": "x"}), (2, {"a": "xyz"}), (3, {"a": "x", "b": "y"}), (4, {"a": "x"}), (4, {"b": "x"}), (5, {"a": "x"})], "batch_id long, labels map<string,string>")
    got = {r.batch_id: r.error for r in limits.check(s, limits.Limits(2, 2, 1, 1)).collect()}
    assert got == {1: "label name length", 2: "label value length", 3: "labels per series", 4: "series per batch", 5: None}


def test_replica_timeline():
    state, out = replicas.Elected(), []
    for replica, now in [("a", 700), ("b", 710), ("a", 720), ("b", 751), ("b", 752), ("a", 753), ("", 754), ("a", 2000)]:
        state, dropped = replicas.decide(state, replica, now)
        out.append(dropped)
    assert out == [False, True, False, True, False, True, False, False]


class TestDelivery:
    @pytest.mark.parametrize(("bytes_", "s", "power"), [(100 << 20, 7201, 4), (100 << 20, 7200, 5), (100 << 20, 3600, 6), (100 << 20, 100, 9), (10, 10, 4), (10, 7200, 0), (32 << 20, 7200, 4), (20 << 20, 7200, 3), (16 << 20, 7300, 3)])
    def test_shard_power(self, spark, bytes_, s, power):
        row = spark.createDataFrame([(4, bytes_, s)], "p int, b long, s long")
        assert row.select(delivery.shard_power(F.col("p"), F.col("b"), F.col("s"))).first()[0] == power

    def test_bad_bounds(self):
        with pytest.raises(ValueError):
            delivery.clamp_shards(F.lit(1), 3, 2)

    def test_pending(self, spark):
        acked = spark.createDataFrame([("d", 0, 1), ("d", 1, None), ("e", 0, 3)], "dest string, shard int, last_segment long")
        written = spark.createDataFrame([(0, 3), (1, 1)], "shard int, max_segment long")
        rejects = spark.createDataFrame([("e", 0, 1), ("d", 0, 3)], "dest string, shard int, segment long")
        finished = spark.createDataFrame([("d", 1)], "dest string, shard int")
        got = sorted(map(tuple, delivery.pending_segments(acked, written, rejects, finished).collect()))
        assert got == [("d", 0, 2), ("d", 0, 3), ("e", 0, 1)]

    def test_pending_ranges_are_counted_out_in_runs(self, spark, monkeypatch):
        monkeypatch.setattr(delivery, "RUN", 7)
        acked = spark.createDataFrame([("d", 0, 4), ("d", 0, 9), ("e", 0, 99), ("e", 1, None)], "dest string, shard int, last_segment long")
        written = spark.createDataFrame([(0, 99), (1, 7)], "shard int, max_segment long")
        rejects = spark.createDataFrame([("d", 0, 2), ("d", 0, 2), ("d", 0, 50), ("f", 3, 8)], "dest string, shard int, segment long")
        finished = spark.createDataFrame([("x", 1)], "dest string, shard int")
        pending = delivery.pending_segments(acked, written, rejects, finished)
        assert sorted(map(tuple, pending.collect())) == sorted([("d", 0, 2), ("f", 3, 8), *(("d", 0, k) for k in range(5, 100)), *(("e", 1, k) for k in range(8))])
        assert pending.where("segment between 5 and 99 and dest = 'd'").select(F.spark_partition_id()).distinct().count() > 1

    def test_retry(self, spark):
        calls = []

        def send(rows, batch_id):
            calls.append(batch_id)
            if len(calls) < 3:
                raise ConnectionError

        stateful.deliver(spark.range(1), 7, send, wait_s=0)
        assert calls == [7, 7, 7]
        with pytest.raises(ConnectionError):
            stateful.deliver(spark.range(1), 7, lambda *_: (_ for _ in ()).throw(ConnectionError()), attempts=2, wait_s=0)


class TestBlocks:
    def test_chunks(self, spark):
        samples = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 3, 2.0), (1, 4, 2.0)], "series_id long, ts_ms long, value double")
        assert sorted(map(tuple, blocks.chunk_stats(samples).collect())) == [(0, 0, 1, 2, 2, False), (1, 0, 3, 4, 2, False)]
        assert blocks.block_meta(samples, 2).count() == 3

    def test_round_trip(self, spark, tmp_path):
        samples = spark.createDataFrame([(k % 3, k * 1000, float(k)) for k in range(100)], "series_id long, ts_ms long, value double")
        blocks.write_blocks(samples, str(tmp_path / "b"), 10_000)
        assert blocks.read_blocks(spark, str(tmp_path / "b"), 5000, 42_000, 10_000).count() == 38

    def test_negative_times_floor(self, spark):
        assert spark.range(1).select(blocks.block_start(F.lit(-1), 10)).first()[0] == -10


def test_stale_markers(spark):
    rows = [("t", 1, "a"), ("t", 1, "b"), ("t", 2, "a"), ("t", 4, "b"), ("u", 1, "a")]
    got = sorted(map(tuple, staleness.stale_markers(spark.createDataFrame(rows, "target string, scrape_ts long, ls_key string")).collect()))
    assert got == [("t", 2, "b"), ("t", 4, "a")]
    assert staleness.as_samples(spark.createDataFrame(got, "target string, scrape_ts long, ls_key string")).where("isnan(value) and is_stale").count() == 2


def test_catalogue(spark):
    log = spark.createDataFrame([(1, 1, 10, 1, 0, False, "new", 0), (1, 2, 10, 2, 0, False, "corrupted", 0), (2, 3, 20, 1, 0, False, "active", 0), (3, 4, 30, 1, 0, False, "persisted", 1), (4, 5, 40, 1, 0, False, "active", 0)], "id long, seq long, created_at long, updated_at long, deleted_at long, corrupted boolean, status string, refs int")
    records = catalog.latest(log)
    assert records.where("id = 1").first().corrupted
    assert {r.id: r.new_status for r in catalog.restored(records, 50, 100).collect()} == {1: "rotated", 2: "rotated", 4: "active"}
    assert [r.id for r in catalog.collectable(records).collect()] == [2]
    assert spark.createDataFrame([(None, 0), (None, 1), (2, 3), (2, 2)], "a long, n long").select(catalog.mismatched("a", "n").alias("x")).collect() == [(False,), (True,), (False,), (True,)]


def test_empty_tables(spark):
    s = series(spark, *FIVE).limit(0)
    samples = spark.createDataFrame([], "series_id long, ts_ms long, value double")
    assert select.select(s, samples, [Matcher("a", "=", "b")], 0, 1).count() == 0
    assert status.totals(s, samples).first()[:] == (0, 0, 0, None, None)
    assert blocks.block_meta(samples).count() == 0


class TestLog:
    def rows(self, spark, *rows):
        df = spark.createDataFrame([("h", *r) for r in rows], "head string, shard int, segment long, labels map<string,string>, ts_ms long, value double")
        return df.withColumn("ls_key", ls.canonical(F.col("labels")))

    def log(self, spark):
        return wal.encode_segments(self.rows(spark, *((s, k, {"__name__": "m", "s": str(s)}, k * 10 + j, math.nan if j else float(k)) for s in (0, 1, 2) for k in range(5) for j in range(2))))

    def test_round_trip(self, spark):
        back = wal.decode_segments(self.log(spark)).orderBy("shard", "segment", "ts_ms").collect()
        assert len(back) == 30 and back[0].labels == {"__name__": "m", "s": "0"} and back[1].ts_ms == 1 and math.isnan(back[1].value)

    def test_a_large_body_is_made_and_read_in_chunks(self, spark, monkeypatch):
        monkeypatch.setattr(remote_write, "CHUNK", 50)
        sizes = {k: 1 + k * 7 % 90 for k in range(40)}
        rows = self.rows(spark, *((k % 2, 0, {"__name__": "m", "s": str(k)}, j, float(k)) for k, n in sizes.items() for j in range(n)))
        made = remote_write._pieces(rows.withColumn("part", F.lit(0)).withColumn("labels", F.expr("transform(map_entries(labels), e -> struct(e.key as name, e.value as value))")).coalesce(1).sortWithinPartitions("shard", "ls_key", "ts_ms"), ["shard"])
        assert made.count() > 10 and made.agg(F.max("samples")).first()[0] < 50 + 90
        log = wal.encode_segments(rows).cache()
        assert {(r.shard, r.samples) for r in log.collect()} == {(s, sum(n for k, n in sizes.items() if k % 2 == s)) for s in (0, 1)}
        for r in log.collect():
            got = remote_write.decode(r.payload)["series"]
            assert sorted(len(x["samples"]) for x in got) == sorted(n for k, n in sizes.items() if k % 2 == r.shard)
        payloads = log.select(F.col("shard").alias("payload_id"), F.col("payload").alias("body"))
        for r in log.collect():
            chunks = remote_write.Requests(limits.Limits()).chunks(r.payload)
            assert len(chunks) > 5 and max(sum(len(x["samples"]) for x in c.to_pylist()[0]) for c in chunks) < 50 + 90
        want = sorted((r.shard, r.ls_key, r.ts_ms, r.value) for r in rows.collect())
        assert sorted((r.shard, r.ls_key, r.ts_ms, r.value) for r in wal.decode_segments(log).collect()) == want
        assert remote_write.decode_chunks(payloads, limits.Limits(samples=100)).count() == 0

    def test_payloads_are_not_sent_to_the_shards(self, spark):
        rows = spark.createDataFrame([("h", 0, 0, 1, 0, b"x")], "head string, shard int, segment long, samples long, crc long, payload binary")
        plan = wal.valid_lengths(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "payload" not in plan[: plan.index("Window")] and "payload" not in plan[plan.index("Window") :].split("\n")[0]

    def test_damage_ends_a_shard(self, spark):
        log = self.log(spark).withColumn("payload", F.when(F.expr("shard = 1 and segment = 2"), F.lit(b"junk")).when(F.expr("shard = 2 and segment = 0"), F.lit(None)).otherwise(F.col("payload")))
        head = wal.load_head(log)
        assert {r.shard: (r.segments, r.corrupted) for r in head.report.collect()} == {0: (5, False), 1: (2, True), 2: (0, True)}
        assert head.samples.count() == 14 and head.series.count() == 2
        states = wal.shard_states(log, 3)
        assert {r.shard: r.state for r in states.collect()} == {0: "ok", 1: "corrupted", 2: "corrupted"}
        assert not wal.end_of_block(states).first().ended and wal.end_of_block(states.where("shard > 0")).first().ended
        assert wal.read_segment(log, 3, 31).select("shard", "ts_ms").collect() == [(0, 31)]
        assert wal.shard_states(log, 9).where("shard = 0").first().state == "wait"

    def test_a_gap_ends_a_shard(self, spark):
        assert wal.valid_lengths(self.log(spark).where("segment <> 3 and shard = 0")).first()[2:] == (3, True)

    def test_empty(self, spark):
        none = self.log(spark).limit(0)
        assert wal.load_head(none).samples.count() == 0 and wal.shard_states(none, 0).count() == 0
        assert wal.notified(wal.flushed(spark.createDataFrame([], "shard int, segment long, ok boolean"))).first().segment is None

    def test_bodies_are_never_empty(self, spark):
        sent = delivery.encode_shards(self.rows(spark, (0, 0, {"a": "b"}, 5, 1.0)).withColumn("batch", F.lit(1)), 4)
        assert delivery.worth_sending(sent).count() == 1 and delivery.worth_sending(sent, 6).count() == 0
        assert delivery.worth_sending(sent.withColumn("body", F.lit(b""))).count() == 0

    def test_batches_close_with_the_segment_that_fills_them(self, spark):
        rows = [("d", k, 2, n, at) for k, (n, at) in enumerate([(5, 0), (6, 1), (1, 2), (1, 50), (3, 60), (30, 61)])]
        got = delivery.send_batches(spark.createDataFrame(rows, "dest string, segment long, shards int, samples int, read_ms long"), 5, 40).orderBy("segment").collect()
        assert [r.batch for r in got] == [0, 0, 1, 1, 2, 2]

    def test_responses_only_move_forward(self, spark):
        acked = spark.createDataFrame([("d", 0, 7), ("d", 1, None)], "dest string, shard int, last_segment long")
        got, rejects = delivery.apply_responses(acked, spark.createDataFrame([("d", 0, 3, True), ("d", 1, 4, True), ("d", 1, 9, False), ("d", 1, 2, False)], "dest string, shard int, segment long, ok boolean"))
        assert sorted(map(tuple, got.collect())) == [("d", 0, 7), ("d", 1, 4)]
        assert [r.segment for r in delivery.rejects_in_order(rejects).collect()] == [2, 9]

    def test_stream_resumes_where_it_stopped(self, spark, tmp_path):
        log, path = self.log(spark), str(tmp_path / "log")
        for k in range(2):
            log.where(F.col("segment") == k).write.mode("append").parquet(path)
            query = stateful.read_log(spark, path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
            query.awaitTermination()
            assert spark.read.parquet(str(tmp_path / "out")).count() == 6 * (k + 1)

    def test_block_stream(self, spark, tmp_path):
        path = str(tmp_path / "in")
        for k in range(2):
            spark.createDataFrame([(1, k * 10 + j, 1.0) for j in range(5)], "series_id long, ts_ms long, value double").write.mode("append").parquet(path)
            stateful.write_blocks(stateful.read(spark, path, "series_id long, ts_ms long, value double"), str(tmp_path / "blocks"), str(tmp_path / "mark"), 10).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "blocks"))
        assert {r.block_start: r["count"] for r in got.groupBy("block_start").count().collect()} == {0: 5, 10: 5}


def test_mapping_cache_is_kept_by_rules(spark):
    s = series(spark, {"a": "x"}, {"a": "y"}, {"b": "z"})
    rules = [Rule(("a",), regex="x", action="drop"), Rule(replacement="1", target_label="c")]
    first = relabel.mapping(s, rules)
    assert {r.ls_key: r.target_key for r in first.collect()} == {"a:x;": None, "a:y;": "a:y;c:1;", "b:z;": "b:z;c:1;"}
    mapped, fresh = relabel.cached_mapping(s, first.where("ls_key = 'a:x;'"), rules)
    assert mapped.count() == 3 and fresh.count() == 2
    assert relabel.cached_mapping(s, first, rules[:1])[1].count() == 3


def test_destinations(spark):
    d = [relabel.Destination("a"), relabel.Destination("b", (("z", "1"),)), relabel.Destination("c", (), (Rule(("x",), regex="1", action="keep"),))]
    assert [x.shrinkable for x in d] == [True, False, True]
    got = relabel.output_relabel(series(spark, {"x": "1"}, {"x": "2", "z": "own"}), d).collect()
    assert sorted((r.dest, r.ls_key) for r in got) == [("a", "x:1;"), ("a", "x:2;z:own;"), ("b", "x:1;z:1;"), ("b", "x:2;z:own;"), ("c", "x:1;")]


def test_out_of_order_samples(spark):
    rows = spark.createDataFrame([(1, 5, 1.0, 0), (1, 5, 2.0, 3), (1, 5, 3.0, 2), (2, 5, 4.0, 0)], "series_id long, ts_ms long, value double, seq long")
    assert sorted(map(tuple, select.latest_wins(rows, "seq").collect())) == [(1, 5, 2.0), (2, 5, 4.0)]


def test_block_ids_sort_by_time(spark):
    got = [r[0] for r in spark.createDataFrame([(1, "a"), (1 << 47, "a"), (1700000000000, "b")], "t long, s string").select(blocks.block_id(F.col("t"), F.col("s"))).collect()]
    assert got[0] < got[2] < got[1] and all(len(x) == 26 and set(x) <= set(blocks.CROCKFORD) for x in got)


def test_blocks_are_described_with_their_id(spark):
    meta = blocks.block_meta(spark.createDataFrame([(1, 5, 1.0), (1, 25, 1.0)], "series_id long, ts_ms long, value double"), 10)
    got = [json.loads(r.json) for r in blocks.meta_json(meta, 1_700_000_000_000).orderBy("block_start").collect()]
    assert [(x["minTime"], x["maxTime"]) for x in got] == [(5, 6), (25, 26)] and got[0]["ulid"] != got[1]["ulid"] and got[0]["ulid"][:10] == got[1]["ulid"][:10]
    assert "ulid" not in json.loads(blocks.meta_json(meta).first().json)


def test_persist_again_after_a_failure(spark, tmp_path):
    heads = spark.createDataFrame([(1, "rotated", False, 90, None, None), (2, "rotated", False, 10, None, None), (3, "rotated", False, 90, 95, None), (4, "persisted", False, 90, None, 20), (5, "active", False, 90, None, None)], "id long, status string, corrupted boolean, max_ts long, tried_ms long, persisted_ms long")
    plan = catalog.persist_plan(heads, 100, 50, 10)
    assert {r.id: r.action for r in plan.collect()} == {1: "write", 2: "discard", 3: "wait", 4: "shrink"}
    samples = spark.createDataFrame([(1, 7, 90, 1.0), (2, 7, 10, 1.0)], "head long, series_id long, ts_ms long, value double")
    done = blocks.persist(samples, plan, str(tmp_path / "b"), 10)
    assert {r.id: r.status for r in done.collect()} == {1: "persisted", 2: "persisted"} and spark.read.parquet(str(tmp_path / "b")).count() == 1
    assert {r.id: r.action for r in catalog.persist_plan(heads, 110, 50, 10).collect()}[3] == "write"


class TestFrames:
    def test_files(self, spark, tmp_path):
        one = [frames.encode("segment", "h", 1, k, 3, b"x" * k) for k in range(300)]
        (tmp_path / "a").write_bytes(b"".join(one))
        (tmp_path / "b").write_bytes(one[0] + frames.encode("segment", None, 7, 1 << 40, 0, b"abc", version=1) + frames.encode("end", "h", 0, 0, 0, b"") + one[9][:-3] + b"??!" + one[5][:-1])
        (tmp_path / "c").write_bytes(b"")
        got = frames.read_files(spark, str(tmp_path))
        assert got.where("source like '%/a' and not corrupted").count() == 300
        other = got.where("source like '%/b'").orderBy("position").collect()
        assert [(r.version, r.kind, r.head, r.shard, r.segment, r.corrupted) for r in other] == [(2, "segment", "h", 1, 0, False), (1, "segment", None, 7, 1 << 40, False), (2, "end", "h", 0, 0, False), (2, "segment", "h", 1, 9, True), (None, None, None, None, None, True)]
        assert frames.received_segments(got).count() == 301
        answers = frames.responses(got.where("source like '%/b'"), "d").collect()
        assert sorted((r.segment, r.ok) for r in answers) == [(0, True), (9, False), (1 << 40, True)]

    def test_stream(self, spark, tmp_path):
        path = tmp_path / "in"
        path.mkdir()
        for k in range(2):
            (path / str(k)).write_bytes(frames.encode("segment", "h", 0, k, 1, b"p"))
            query = frames.read_files(spark, str(path), stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
            query.awaitTermination()
            assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1

    def test_hostile_bytes(self, spark):
        rows = [(1, None), (2, bytearray(b"")), (3, bytearray(b"\xa5")), (4, bytearray(b"\xa5\x02\x00" + b"\xff" * 20)), (5, bytearray(b"hello"))]
        got = frames.decode_frames(spark.createDataFrame(rows, "source int, bytes binary")).collect()
        assert sorted((r.source, r.corrupted) for r in got) == [(3, True), (4, True), (5, True)]
