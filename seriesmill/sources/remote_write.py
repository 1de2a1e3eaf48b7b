"""Remote-write requests: the snappy-framed protobuf form, and its rows.

The wire format is decoded in Arrow batches, since Spark has no built-in for it; all that follows is
expressions on the decoded structs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labelset import from_pairs, sorted_entries
from .limits import Limits

LABEL = "struct<name:string,value:string>"
REQUEST = f"series array<struct<labels:array<{LABEL}>,samples:array<struct<ts_ms:bigint,value:double>>>>, metadata array<struct<metric_name:string,type:int,help:string,unit:string>>"
SERIES = pa.list_(pa.struct([("labels", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("samples", pa.list_(pa.struct([("ts_ms", pa.int64()), ("value", pa.float64())])))]))
METADATA = pa.list_(pa.struct([("metric_name", pa.string()), ("type", pa.int32()), ("help", pa.string()), ("unit", pa.string())]))
DOUBLE = struct.Struct("<d")
#: Bodies that are decoded or encoded at once, while they hold no more samples than a chunk.
BODIES = 64
#: Samples in a chunk: what a worker decodes or encodes before it hands it on.
CHUNK = 8192
#: Parts that the series of a body are dealt to, so that several workers encode a large one.
PARTS = 16
#: The numbers of metric types on the wire.
TYPES = ("unknown", "counter", "gauge", "histogram", "gaugehistogram", "summary", "info", "stateset")


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out & (1 << 64) - 1, at
        shift += 7
        if shift > 63:
            raise ValueError("varint is too long")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; fixed and length-prefixed values as bytes."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = read_varint(data, at)
            yield key >> 3, value
            continue
        size = 8 if kind == 1 else 4 if kind == 5 else None
        if kind == 2:
            size, at = read_varint(data, at)
        if size is None or at + size > len(data):
            raise ValueError("bad wire type or length")
        yield key >> 3, data[at : at + size]
        at += size


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


#: What reading a request that has not the right form raises.
ERRORS = (ValueError, IndexError, OSError, struct.error, AttributeError, TypeError)


class LimitExceeded(ValueError):
    """A request that breaks a limit; it is rejected as a whole, and no more of it is read."""


class Requests:
    """Decoded requests as flat columns: a list for each leaf, and ends of lists, in the order of the wire."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self._clear()

    def _clear(self) -> None:
        self.names, self.values, self.label_ends = [], [], [0]
        self.stamps, self.numbers, self.sample_ends = [], [], [0]
        self.meta, self.series_ends, self.meta_ends, self.errors = [], [0], [0], []

    def add(self, payload: bytes | None) -> None:
        """A request of a snappy block; one that can't be read or breaks a limit leaves only its error."""
        kept = [len(x) for x in (self.names, self.values, self.label_ends, self.stamps, self.numbers, self.sample_ends, self.meta)]
        error = None
        try:
            self._read(payload or b"\x00")
        except ERRORS as e:
            error = str(e) or type(e).__name__
            for x, n in zip((self.names, self.values, self.label_ends, self.stamps, self.numbers, self.sample_ends, self.meta), kept, strict=True):
                del x[n:]
        self.series_ends.append(len(self.label_ends) - 1)
        self.meta_ends.append(len(self.meta))
        self.errors.append(error)

    def chunks(self, payload: bytes | None) -> list[pa.Array]:
        """The series of one request as arrays of a row, each of some CHUNK samples or labels; none if it can't be read or breaks a limit.

        Only columns are kept until the request's end, which decides whether it counts.
        """
        out: list[pa.Array] = []

        def cut() -> None:
            self.series_ends.append(len(self.label_ends) - 1)
            self.meta_ends.append(len(self.meta))
            self.errors.append(None)
            out.append(self.arrays()[0])
            self._clear()

        try:
            self._read(payload or b"\x00", cut)
            if len(self.label_ends) > 1:
                cut()
        except ERRORS:
            out = []
        self._clear()
        return out

    def _read(self, payload: bytes, cut: Callable[[], None] | None = None) -> None:
        size, _ = read_varint(payload, 0)
        data = pa.Codec("snappy").decompress(payload, size, asbytes=True) if size else b""
        series = samples = 0
        limits = self.limits
        for number, value in fields(data):
            if number == 1:
                series += 1
                first = len(self.names)
                for n, part in fields(value):
                    if n == 1:
                        self._label(part)
                    elif n == 2:
                        self._sample(part)
                        samples += 1
                if limits.labels and len(self.names) - first > limits.labels:
                    raise LimitExceeded("labels per series")
                if limits.series and series > limits.series:
                    raise LimitExceeded("series per batch")
                if limits.samples and samples > limits.samples:
                    raise LimitExceeded("samples per batch")
                self.label_ends.append(len(self.names))
                self.sample_ends.append(len(self.stamps))
                if cut and (len(self.stamps) >= CHUNK or len(self.names) >= 4 * CHUNK):
                    cut()
            elif number == 3:
                got = dict(fields(value))
                self.meta.append((got.get(2, b"").decode(), got.get(1, 0), got.get(4, b"").decode(), got.get(5, b"").decode()))

    def _label(self, part: bytes) -> None:
        name = value = b""
        n = len(part)
        size = part[1] if n > 1 else 0
        # Nearly always a short name and then a short value.
        if n > 1 and part[0] == 10 and size < 128 and n > size + 3 and part[size + 2] == 18 and part[size + 3] < 128 and n == size + 4 + part[size + 3]:
            name, value = part[2 : size + 2], part[size + 4 :]
        else:
            got = dict(fields(part))
            name, value = got.get(1, b""), got.get(2, b"")
        if self.limits.name_length and len(name) > self.limits.name_length:
            raise LimitExceeded("label name length")
        if self.limits.value_length and len(value) > self.limits.value_length:
            raise LimitExceeded("label value length")
        self.names.append(name.decode())
        self.values.append(value.decode())

    def _sample(self, part: bytes) -> None:
        if len(part) > 10 and part[0] == 9 and part[9] == 16:
            self.numbers.append(DOUBLE.unpack_from(part, 1)[0])
            self.stamps.append(signed(read_varint(part, 10)[0]))
        else:
            got = dict(fields(part))
            self.numbers.append(DOUBLE.unpack(got.get(1, bytes(8)))[0])
            self.stamps.append(signed(got.get(2, 0)))

    def arrays(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(series, metadata, error) of all requests."""
        labels = pa.ListArray.from_arrays(pa.array(self.label_ends, pa.int32()), pa.StructArray.from_arrays([pa.array(self.names, pa.string()), pa.array(self.values, pa.string())], ["name", "value"]))
        samples = pa.ListArray.from_arrays(pa.array(self.sample_ends, pa.int32()), pa.StructArray.from_arrays([pa.array(self.stamps, pa.int64()), pa.array(self.numbers, pa.float64())], ["ts_ms", "value"]))
        series = pa.ListArray.from_arrays(pa.array(self.series_ends, pa.int32()), pa.StructArray.from_arrays([labels, samples], ["labels", "samples"]))
        columns = [pa.array([m[k] for m in self.meta], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))]
        metadata = pa.ListArray.from_arrays(pa.array(self.meta_ends, pa.int32()), pa.StructArray.from_arrays(columns, ["metric_name", "type", "help", "unit"]))
        return series, metadata, pa.array(self.errors, pa.string())


def decode(payload: bytes, limits: Limits | None = None) -> dict:
    """One request; raises if it can't be read."""
    out = Requests(limits or Limits())
    out.add(payload)
    series, metadata, error = (a.to_pylist()[0] for a in out.arrays())
    if error is not None:
        raise ValueError(error)
    return {"series": series, "metadata": metadata}


def _part(key: int, data: bytes) -> bytes:
    n = len(data)
    return bytes((key, n)) + data if n < 128 else bytes((key,)) + varint(n) + data


def _ends(lists: pa.ListArray) -> list[int]:
    return [0, *pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).to_pylist()]


def _pairs(labels: pa.ListArray) -> list[bytes]:
    """Encoded labels; equal names and values are encoded once."""
    pairs = labels.flatten()
    name = pairs.field("name").dictionary_encode()
    value = pairs.field("value").dictionary_encode()
    names = [_part(10, x.encode()) for x in name.dictionary.to_pylist()]
    values = [_part(18, x.encode()) for x in value.dictionary.to_pylist()]
    return [_part(10, names[a] + values[b]) for a, b in zip(name.indices.to_pylist(), value.indices.to_pylist(), strict=True)]


def _dots(stamps: pa.Array, values: pa.Array) -> list[bytes]:
    """Encoded samples."""
    raw = values.to_numpy(zero_copy_only=False).astype("<f8").tobytes()
    dots = []
    for k, ts in enumerate(stamps.to_pylist()):
        body = b"\x09" + raw[k * 8 : k * 8 + 8] + b"\x10" + varint(ts)
        dots.append(bytes((18, len(body))) + body)
    return dots


def _bodies(series: pa.ListArray, metadata: pa.ListArray) -> list[bytes]:
    """Snappy blocks of requests, from flat columns."""
    each = series.flatten()
    labels, samples, meta = each.field("labels"), each.field("samples"), metadata.flatten().to_pylist()
    points = samples.flatten()
    encoded, dots = _pairs(labels), _dots(points.field("ts_ms"), points.field("value"))
    of_label, of_sample, of_series, of_meta = _ends(labels), _ends(samples), _ends(series), _ends(metadata)
    whole = [_part(10, b"".join(encoded[of_label[k] : of_label[k + 1]]) + b"".join(dots[of_sample[k] : of_sample[k + 1]])) for k in range(len(each))]
    codec, out = pa.Codec("snappy"), []
    for k in range(len(series)):
        body = b"".join(whole[of_series[k] : of_series[k + 1]])
        for m in meta[of_meta[k] : of_meta[k + 1]]:
            body += _part(26, b"\x08" + varint(m["type"]) + _part(18, m["metric_name"].encode()) + _part(34, m["help"].encode()) + _part(42, m["unit"].encode()))
        out.append(codec.compress(body, asbytes=True))
    return out


def encode(request: dict) -> bytes:
    return _bodies(pa.array([request["series"]], SERIES), pa.array([request.get("metadata") or []], METADATA))[0]


def decode_payloads(payloads: DataFrame, limits: Limits | None = None) -> DataFrame:
    """payloads(payload_id, body) as (payload_id, series, metadata, error).

    error says why a body can't be read or which limit it breaks; limits hold while it is read, so a hostile
    one is not decoded to its end.
    """
    schema = f"payload_id {payloads.schema['payload_id'].dataType.simpleString()}, {REQUEST}, error string"
    bound = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at, got = 0, Requests(bound)
            for k, body in enumerate(whole.column("body"), 1):
                got.add(body.as_py())
                if k == whole.num_rows or k - at == BODIES or len(got.stamps) >= CHUNK:
                    yield pa.RecordBatch.from_arrays([whole.column("payload_id").slice(at, k - at), *got.arrays()], names=["payload_id", "series", "metadata", "error"])
                    at, got = k, Requests(bound)

    return payloads.select("payload_id", "body").mapInArrow(run, schema)


def decode_chunks(payloads: DataFrame, limits: Limits | None = None) -> DataFrame:
    """payloads(payload_id, body) as (payload_id, series): a row for each chunk of a body's series, so that no row grows with its body.

    A body that can't be read or breaks a limit gives nothing.
    """
    schema = f"payload_id {payloads.schema['payload_id'].dataType.simpleString()}, {REQUEST.split(', metadata')[0]}"
    bound = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("payload_id")
            held, rows, size = [], [], 0
            for k, body in enumerate(batch.column("body")):
                for chunk in Requests(bound).chunks(body.as_py()):
                    held.append(chunk)
                    rows.append(k)
                    size += len(chunk.flatten())
                    if size >= CHUNK:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.concat_arrays(held)], names=["payload_id", "series"])
                        held, rows, size = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.concat_arrays(held)], names=["payload_id", "series"])

    return payloads.select("payload_id", "body").mapInArrow(run, schema)


def encode_payloads(requests: DataFrame) -> DataFrame:
    """requests(payload_id, series, metadata) as (payload_id, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BODIES):
                batch = whole.slice(at, BODIES)
                yield pa.RecordBatch.from_arrays([batch.column("payload_id"), pa.array(_bodies(batch.column("series"), batch.column("metadata")), pa.binary())], names=["payload_id", "body"])

    kind = requests.schema["payload_id"].dataType.simpleString()
    return requests.select("payload_id", "series", "metadata").mapInArrow(run, f"payload_id {kind}, body binary")


def _pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., part, piece, size, samples, series, max_ts, stream) of sorted rows(keys..., part, ls_key, labels, ts_ms, value).

    A piece is the compressed stream of some CHUNK samples, of whole series; what a worker holds is one piece.
    """
    place = [*keys, "part"]
    types = {c: rows.schema[c].dataType.simpleString() for c in place}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", piece int, size long, samples long, series long, max_ts long, stream binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("snappy")
        kinds: list[pa.DataType] = []
        now = series = None  # where the rows are: the place and the series
        whole: list[bytes] = []  # encoded series of the open piece
        points: list[bytes] = []  # encoded samples of the open series
        head, piece, samples, top, made = b"", 0, 0, None, []

        def end_series() -> None:
            nonlocal head, points
            if points:
                whole.append(_part(10, head + b"".join(points)))
                points = []

        def end_piece() -> None:
            nonlocal whole, samples, top, piece
            if whole:
                data = b"".join(whole)
                packed = codec.compress(data, asbytes=True)
                made.append((*now, piece, len(data), samples, len(whole), top, packed[read_varint(packed, 0)[1] :]))
                whole, samples, top, piece = [], 0, None, piece + 1

        def rows_made() -> pa.RecordBatch:
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((*kinds, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*place, "piece", "size", "samples", "series", "max_ts", "stream"])

        for batch in batches:
            kinds = [batch.column(c).type for c in place]
            places = list(zip(*(batch.column(c).to_pylist() for c in place), strict=True))
            names, stamps = batch.column("ls_key").to_pylist(), batch.column("ts_ms").to_pylist()
            dots = _dots(batch.column("ts_ms"), batch.column("value"))
            firsts = [k for k, x in enumerate(zip(places, names, strict=True)) if x != ((places[k - 1], names[k - 1]) if k else (now, series))]
            labels = batch.column("labels").take(pa.array(firsts, pa.int64()))
            encoded, ends = _pairs(labels), _ends(labels)
            for i, (at, to) in enumerate(zip([0, *firsts], [*firsts, batch.num_rows], strict=True)):
                if i:
                    end_series()
                    if places[at] != now or samples >= CHUNK:
                        end_piece()
                    if places[at] != now:
                        now, piece = places[at], 0
                    series, head = names[at], b"".join(encoded[ends[i - 1] : ends[i]])
                if at < to:
                    points += dots[at:to]
                    samples += to - at
                    top = max(stamps[at:to] if top is None else (top, *stamps[at:to]))
            if made:
                yield rows_made()
        end_series()
        end_piece()
        if made:
            yield rows_made()

    return rows.select(*place, "ls_key", "labels", "ts_ms", "value").mapInArrow(run, schema)


def _varint_of(n: Column) -> Column:
    """A number below 2^35 as a varint."""
    digits = [F.when(F.shiftright(n, 7 * k) > 0, F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(127) + F.when(F.shiftright(n, 7 * k + 7) > 0, 128).otherwise(0)), 2, "0")) for k in range(5)]
    return F.unhex(F.concat_ws("", *digits))


def bodies_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., samples, series, max_ts, body): one request for each key of rows(keys..., labels, ls_key, ts_ms, value).

    The series of a key are dealt to PARTS by a hash, and each part is encoded in pieces by a worker that streams
    its rows in order; a snappy block is the size and then the streams of its pieces one after another, as they
    refer to nothing before them. So no worker holds a body, however large, nor a list of its samples.
    """
    pairs = F.transform(sorted_entries(F.col("labels")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    dealt = rows.select(*keys, F.pmod(F.xxhash64("ls_key"), F.lit(PARTS)).cast("int").alias("part"), "ls_key", pairs.alias("labels"), "ts_ms", "value")
    ordered = dealt.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "ls_key", "ts_ms", "value")
    made = _pieces(ordered, keys).groupBy(*keys).agg(
        F.sum("samples").alias("samples"),
        F.sum("series").alias("series"),
        F.max("max_ts").alias("max_ts"),
        F.concat(_varint_of(F.sum("size")), F.expr("listagg(stream) WITHIN GROUP (ORDER BY part, piece)")).alias("body"),
    )
    return made.select(*keys, "samples", "series", "max_ts", "body")


def requests_of_structs(rows: DataFrame) -> DataFrame:
    """rows(payload_id, labels ARRAY<STRUCT<name, value>>, ts_ms, value), a sample each, as requests(payload_id, series, metadata).

    For batches that a caller holds as structs; a batch is one request.
    """
    one = F.struct(F.transform(F.col("labels"), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"))).alias("labels"), F.array(F.struct("ts_ms", "value")).alias("samples"))
    none = F.array().cast("array<struct<metric_name:string,type:int,help:string,unit:string>>")
    return rows.groupBy("payload_id").agg(F.collect_list(one).alias("series")).withColumn("metadata", none)


def samples_of(requests: DataFrame) -> DataFrame:
    """(payload_id, labels, ts_ms, value), a row for each sample."""
    each = requests.select("payload_id", F.explode("series").alias("s"))
    return each.select("payload_id", from_pairs(F.col("s.labels")).alias("labels"), F.explode("s.samples").alias("x")).select("payload_id", "labels", "x.ts_ms", "x.value")


def metadata_of(requests: DataFrame) -> DataFrame:
    """(payload_id, metric_name, kind, text): a row for the help, the type and the unit of each metric."""
    m = requests.select("payload_id", F.explode("metadata").alias("m"))
    kinds = F.array(
        F.struct(F.lit("help").alias("kind"), F.col("m.help").alias("text")),
        F.struct(F.lit("type").alias("kind"), F.get(F.array(*map(F.lit, TYPES)), F.col("m.type")).alias("text")),
        F.struct(F.lit("unit").alias("kind"), F.col("m.unit").alias("text")),
    )
    return m.select("payload_id", F.col("m.metric_name").alias("metric_name"), F.explode(kinds).alias("k")).select("payload_id", "metric_name", "k.kind", "k.text")


def origin(requests: DataFrame) -> DataFrame:
    """(payload_id, cluster, replica) of each request's first series."""
    first = from_pairs(F.get("series", 0)["labels"])
    return requests.select("payload_id", F.try_element_at(first, F.lit("cluster")).alias("cluster"), F.try_element_at(first, F.lit("__replica__")).alias("replica"))


def requests_of(samples: DataFrame, per_request: int = 10_000, window_ms: int = 7_200_000, requests: int | None = None) -> DataFrame:
    """Requests of samples(labels, ls_key, ts_ms, value): runs of a series' samples in order of time, many to a request.

    A run is a series' samples of one window, at most per_request of them. A window's runs are dealt to as
    many requests as give each some per_request samples, by the window's own count, so nothing is counted
    ahead and no list grows with the table.
    """
    window = F.floor(F.col("ts_ms") / window_ms)
    runs = samples.groupBy("ls_key", window.alias("w")).agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("samples"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / per_request).cast("int")), lambda k: F.slice("samples", k * per_request + 1, per_request))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    if requests is None:
        sizes = samples.groupBy(window.alias("w")).agg(F.ceil(F.count("*") / per_request).alias("parts"))
        runs = runs.join(sizes, "w")
        place = F.struct("w", F.pmod(F.xxhash64("ls_key", "k"), F.col("parts")).alias("part"))
    else:
        place = F.struct(F.lit(0).cast("long").alias("w"), F.pmod(F.xxhash64("ls_key", "w", "k"), F.lit(requests)).alias("part"))
    shaped = runs.select("*", F.posexplode(cuts).alias("k", "cut")).select(F.xxhash64(place).alias("payload_id"), place.alias("place"), F.struct(pairs.alias("labels"), F.col("cut").alias("samples")).alias("s"))
    none = F.array().cast("array<struct<metric_name:string,type:int,help:string,unit:string>>")
    return shaped.groupBy("place").agg(F.first("payload_id").alias("payload_id"), F.collect_list("s").alias("series")).select("payload_id", "series", none.alias("metadata"))
