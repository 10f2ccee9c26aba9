"""Media columns stored as content-defined chunks (operator 6).

A payload becomes a media file: a binary grey-map (a short header and 8-bit samples, WIDTH to
a line). A rolling gear hash cuts the file into chunks at places that its own bytes decide.
Chunks are named by digest. A first pass writes where each digest stands; from that table
alone come the digests that more than one place holds, and each one's owner. The store has one row per distinct file, its ordered
chunk list: the bytes of chunks that no other place holds stand in it, shared chunks are
references, and their owner's row lends the bytes, once. Reading joins the references with
the lent chunks, puts each file together again and verifies its digest; files without
references are read in place and never shuffled.

Files are kept per distinct text and compressed before the shuffle that folds copies; rows
join the results by the text's digest, so a popular text or chunk makes no large group.

Cases: null text is the empty payload (padding alone); equal texts have equal values; repeated
rows each return a row; a very long text is one payload, cut like any other; extra columns are
ignored; an empty table returns no rows. A file that does not match its digest
raises an error.
"""

from __future__ import annotations

import bz2
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm._stage import Stage, keyed

WIDTH, UNIT, PAD = 576, 576, 255
#: Least and greatest chunk; the mask gives 16 KiB between cuts on average.
LEAST, GREATEST, MASK = 4096, 65536, T.U((1 << 14) - 1) << T.U(40)
WINDOW = 16


def payload(text: bytes) -> bytes:
    """The text, padded to a positive multiple of UNIT."""
    return text + bytes([PAD]) * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def encode(data: bytes) -> bytes:
    """The payload as the samples of a grey-map."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def decode(media: bytes) -> np.ndarray:
    """The samples of a grey-map, line by line."""
    kind, size, top, data = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or top != b"255" or len(data) != width * height:
        raise ValueError("not a whole 8-bit grey-map")
    return np.frombuffer(data, np.uint8).reshape(height, width)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the gear hash of the last bytes has zeros, no sooner than LEAST and no later than GREATEST."""
    n = len(data)
    if n <= LEAST:
        return [n]
    code = T.TABLE[np.frombuffer(data, np.uint8)]
    h = np.zeros(n, T.U)
    for i in range(WINDOW):  # the gear hash is a shift and an add a byte; these are its last WINDOW terms
        h[i:] += code[: n - i] << T.U(i)
    ok = np.flatnonzero((h & MASK) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(ok, at + LEAST))
        end = int(ok[k]) if k < len(ok) else n
        at = min(end, at + GREATEST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


FILE = "k binary, n_bytes long, media_sha256 string, digests array<binary>, parts array<binary>"


def squeeze(part: bytes) -> bytes:
    """A chunk in the smaller of two compressed forms; each begins with its own sign."""
    return min(zstandard.ZstdCompressor(level=9).compress(part), bz2.compress(part, 9), key=len)


def expand(chunk: bytes) -> bytes:
    return bz2.decompress(chunk) if chunk[:3] == b"BZh" else zstandard.ZstdDecompressor().decompress(chunk)


def _files(chunks: bool):
    """Rows as files: their chunks' digests and, if asked, their chunks, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.bytes_of(batch.column("text"))
            keys = batch.column("k").to_pylist()
            for lo, hi in T.slices(off):
                out: dict[str, list] = {c: [] for c in ("k", "n_bytes", "media_sha256", "digests", "parts")}
                for i in range(lo, hi):
                    text = buf[off[i] : off[i + 1]].tobytes()
                    media = encode(payload(text))
                    ends = cuts(media)
                    parts = [media[a:b] for a, b in zip([0, *ends], ends)]
                    row = (keys[i], len(text), hashlib.sha256(media).hexdigest(), [hashlib.sha256(x).digest()[:16] for x in parts], [squeeze(x) for x in parts] if chunks else None)
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array(out["k"], pa.binary()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "media_sha256": pa.array(out["media_sha256"], pa.string()),
                    "digests": pa.array(out["digests"], pa.list_(pa.binary())), "parts": pa.array(out["parts"], pa.list_(pa.binary()))})

    return run


def store(docs: DataFrame, stage: Stage) -> DataFrame:
    """The store: k, n_bytes, media_sha256, own (chunks, null where shared), refs (place, digest), lent (digest, chunk)."""
    texts = keyed(docs).select("k", "text")
    place = stage.table("places", texts.mapInArrow(_files(False), FILE).select("k", F.posexplode("digests").alias("place", "digest")).distinct())
    at = F.struct("k", "place")
    shared = place.groupBy("digest").agg(F.min(at).alias("owner"), F.max(at).alias("last")).filter("owner != last").select("digest", "owner")
    marks = place.join(shared, "digest").groupBy("k").agg(F.collect_list(F.struct("place", "digest", (F.col("owner") == at).alias("lends"))).alias("marks"))
    marks = stage.table("marks", marks)
    stage.drop("places")
    file = F.first(F.struct("n_bytes", "media_sha256", "parts")).alias("file")
    files = texts.mapInArrow(_files(True), FILE).groupBy("k").agg(file).join(marks, "k", "left").select("k", "file.*", "marks")
    own = F.when(F.col("marks").isNull(), F.col("parts")).otherwise(
        F.transform("parts", lambda x, i: F.when(~F.exists("marks", lambda m: m["place"] == i), x)))
    lent = F.transform(F.filter("marks", lambda m: m["lends"]), lambda m: F.struct(m["digest"].alias("digest"), F.element_at("parts", m["place"] + 1).alias("chunk")))
    refs = F.transform("marks", lambda m: F.struct(m["place"].alias("place"), m["digest"].alias("digest")))
    files = stage.table("files", files.select("k", "n_bytes", "media_sha256", own.alias("own"), refs.alias("refs"), lent.alias("lent")))
    stage.drop("marks")
    return files


def feature(samples: np.ndarray) -> str:
    """Height, mean, spread and the mean of the upper and the left half of the samples."""
    x = samples.astype(np.float64)
    half = x[: max(1, len(x) // 2)]
    return f"{len(x)}x{x.shape[1]};{x.mean():.4f};{x.std():.4f};{half.mean():.4f};{x[:, : x.shape[1] // 2].mean():.4f}"


def _assemble(columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = list(r["own"])
                for x in r["found"] or ():
                    parts[x["place"]] = x["chunk"]
                if None in parts:
                    raise ValueError("a stored file lacks a chunk")
                media = b"".join(map(expand, parts))
                if hashlib.sha256(media).hexdigest() != r["media_sha256"]:
                    raise ValueError("a stored file does not match its digest")
                samples = decode(media)
                data = samples.tobytes()
                got = {"k": r["k"], "n_bytes": r["n_bytes"], "payload": data, "media": media, "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(),
                       "tail_crc32": zlib.crc32(data[-32:]), "media_bytes": len(media), "media_sha256": r["media_sha256"], "feature": feature(samples)}
                rows.append({c: got[c] for c in ("k", *columns)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, ARROW[READ[c]]) for c in ("k", *columns)]))

    return run


READ = {"k": "binary", "n_bytes": "long", "payload": "binary", "media": "binary", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
ARROW = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
DIGESTS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def read(files: DataFrame, columns: tuple[str, ...] = DIGESTS) -> DataFrame:
    """Each file put together again from the store: k and the given columns of `READ`."""
    chunks = files.filter("size(lent) > 0").select(F.inline("lent"))
    split = files.filter("size(refs) > 0")
    found = split.select("k", F.inline("refs")).join(chunks, "digest").groupBy("k").agg(F.collect_list(F.struct("place", "chunk")).alias("found"))
    columns_in = ("k", "n_bytes", "media_sha256", "own", "found")
    local = files.filter("refs is null or size(refs) = 0").withColumn("found", F.lit(None).cast(found.schema["found"].dataType)).select(*columns_in)
    schema = ", ".join(f"{c} {READ[c]}" for c in ("k", *columns))
    return local.mapInArrow(_assemble(columns), schema).unionByName(split.join(found, "k").select(*columns_in).mapInArrow(_assemble(columns), schema))


def round_trip(docs: DataFrame, columns: tuple[str, ...] = DIGESTS) -> DataFrame:
    """Store every text of docs, read it back, and return doc_id with the given columns of what was read."""
    stage = Stage(docs.sparkSession, "media")
    return keyed(docs).select("doc_id", "k").join(read(store(docs, stage), columns), "k").select("doc_id", *columns)
