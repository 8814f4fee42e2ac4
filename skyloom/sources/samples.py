"""Sample tables: (tod, det, samp, dat, ipix, ...) rows from the bundled star-schema tables and from files."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NX, NY = 32, 24


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timestream for each event type, four detectors each; azimuth in degrees and time in seconds are columns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy("tod", "det").orderBy("ts", "event_id")
    return e.select(
        F.col("event_type").alias("tod"), (F.col("user_id") % 4).alias("det"), "event_id", "ts", F.col("value").alias("dat"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ctime"),
        ((F.col("event_id") * 7 % NX) * NY + F.col("user_id") * 13 % NY).alias("ipix"), (F.col("event_id") * 37 % 360).cast("double").alias("az"),
    ).withColumn("samp", (F.row_number().over(w) - 1).cast("long"))


EVENTS_SQL = """samples AS (SELECT event_type AS tod, user_id % 4 AS det, event_id, ts, value AS dat, epoch_us(ts) / 1e6 AS ctime,
 (event_id * 7 % 32) * 24 + user_id * 13 % 24 AS ipix, CAST(event_id * 37 % 360 AS DOUBLE) AS az,
 row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS samp FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as rectangular timestreams: a label is a timestream, a vector a detector."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("label").alias("tod"), F.col("vec_id").alias("det"), F.posexplode("embedding").alias("samp", "x")).select("tod", "det", F.col("samp").cast("long").alias("samp"), F.col("x").cast("double").alias("dat"))


VECTORS_SQL = """samples AS (SELECT label AS tod, vec_id AS det, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS samp, CAST(unnest(embedding) AS DOUBLE) AS dat FROM embeddings)"""

#: Types of the tagged binary array format, by code.
TAGGED = {8: "<f8", 4: "<f4", -4: "<i4", -8: "<i8", 1: "S1"}


def parse_tagged(data: bytes) -> dict[str, np.ndarray]:
    """Arrays of a tagged binary file: key count; for each key a name line, dimension count, dimensions in reverse, type code, values."""
    out, at = {}, 4
    for _ in range(struct.unpack_from("<i", data)[0]):
        end = data.index(b"\n", at)
        name, at = data[at:end].decode().strip(), end + 1
        (ndim,) = struct.unpack_from("<i", data, at)
        dims = struct.unpack_from(f"<{ndim}i", data, at + 4)[::-1]
        (code,) = struct.unpack_from("<i", data, at + 4 + 4 * ndim)
        at += 8 + 4 * ndim
        kind = np.dtype(TAGGED[code])
        count = int(np.prod(dims))
        out[name] = np.frombuffer(data, kind, count, at).reshape(dims)
        at += count * kind.itemsize
    return out


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, dims, values) of every array in tagged binary files; text arrays have no values."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, k, list(a.shape), a.ravel().astype(float).tolist() if a.dtype.kind != "S" else []) for p, d in zip(frame["path"], frame["content"], strict=True) for k, a in parse_tagged(bytes(d)).items()]
            yield pd.DataFrame(rows, columns=["path", "key", "dims", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, key string, dims array<int>, values array<double>")


def parse_fits(data: bytes) -> list[tuple[dict, np.ndarray | None]]:
    """(header, data) of each unit of a FITS file: images as arrays, binary tables as record arrays."""
    out, at = [], 0
    kinds = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
    while at < len(data):
        head, done = {}, False
        while not done:
            for k in range(0, 2880, 80):
                card = data[at + k : at + k + 80].decode("ascii", "replace")
                name = card[:8].strip()
                if name == "END":
                    done = True
                    break
                if card[8:10] == "= ":
                    body = card[10:].split("/")[0].strip() if "'" not in card else card[card.index("'") + 1 : card.rindex("'")].strip()
                    try:
                        head[name] = body if "'" in card else (body == "T" if body in ("T", "F") else float(body) if any(c in body for c in ".E") else int(body))
                    except ValueError:
                        head[name] = body
            at += 2880
        dims = [head[f"NAXIS{i + 1}"] for i in range(head.get("NAXIS", 0))]
        size = abs(head.get("BITPIX", 8)) // 8 * int(np.prod(dims)) + head.get("PCOUNT", 0) if dims else 0
        body = None
        if dims and head.get("XTENSION", "").startswith("BINTABLE"):
            fields = []
            for i in range(head["TFIELDS"]):
                form = head[f"TFORM{i + 1}"]
                many, code = form.rstrip("LBIJKEDA")[:9] or "1", form.strip("0123456789")[:1]
                fields.append((head[f"TTYPE{i + 1}"], f"S{many}") if code == "A" else (head[f"TTYPE{i + 1}"], kinds[code], (int(many),)) if many != "1" else (head[f"TTYPE{i + 1}"], kinds[code]))
            body = np.frombuffer(data, np.dtype(fields), dims[1], at)
        elif dims:
            kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[head["BITPIX"]]
            body = np.frombuffer(data, kind, int(np.prod(dims)), at).reshape(dims[::-1])
        out.append((head, body))
        at += -(-size // 2880) * 2880
    return out


def read_fits_samples(spark: SparkSession, path: str, branch: float | None = None, good: float = 9e5) -> DataFrame:
    """Samples of detector-major FITS tables: columns PIXID, DX, DY, TIME, FNU and, where given, UFNU (below ``good``: kept) and ELEV."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for p, d in zip(frame["path"], frame["content"], strict=True):
                t = next(b for _, b in parse_fits(bytes(d)) if b is not None and b.dtype.names)
                det = t["PIXID"].astype(np.int64)
                n = len(t) // len(np.unique(det))
                dx = t["DX"].astype(float)
                bad = t["UFNU"].astype(float) if "UFNU" in t.dtype.names else np.zeros(len(t))
                yield pd.DataFrame({"tod": p, "det": det, "samp": np.arange(len(t)) % n, "ctime": t["TIME"].astype(float), "dx": np.where(dx > branch, dx - 2 * np.pi, dx) if branch is not None else dx, "dy": t["DY"].astype(float), "dat": t["FNU"].astype(float), "mask": bad < good, "elev": np.deg2rad(t["ELEV"].astype(float)) if "ELEV" in t.dtype.names else np.nan})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "tod string, det long, samp long, ctime double, dx double, dy double, dat double, mask boolean, elev double")


def polarimeter_samples(data: bytes, polarised: bool = False, swapped: bool = True, intervals: bool = False) -> dict[str, np.ndarray]:
    """Columns of a polarimeter's FITS table: half sums of both channels, I alone or Q and U as detectors 0 and 1.

    ``swapped``: the detectors are -U and Q.  ``intervals``: samples outside all START to END (exclusive) rows of the unit 3 are masked, if the file has it.
    """
    units = parse_fits(data)
    t = units[1][1]
    half = {k: 0.5 * (t[f"{k}1"].astype(float) + t[f"{k}2"].astype(float)) for k in ("IQU" if polarised else "I")}
    rows = ([-half["U"], half["Q"]] if swapped else [half["Q"], half["U"]]) if polarised else [half["I"]]
    keep, n = t["FLAG"].astype(int) == 0, len(t)
    if intervals and len(units) > 3:
        edge = np.zeros(n + 1, int)
        for name, sign in (("START", 1), ("END", -1)):
            np.add.at(edge, np.clip(units[3][1][name].astype(int), 0, n), sign)
        keep = keep & (np.cumsum(edge[:-1]) > 0)
    each = {"ctime": (t["MJD"].astype(float) - 2455977.5 + 2400000.5) * 86400 + 1329696000, "dx": t["RA"].astype(float), "dy": t["DEC"].astype(float), "mask": keep, "az": np.deg2rad(t["AZ"].astype(float)), "elev": np.deg2rad(t["EL"].astype(float))}
    return {"det": np.repeat(np.arange(len(rows)), n), "samp": np.tile(np.arange(n), len(rows)), "dat": np.concatenate(rows)} | {k: np.tile(v, len(rows)) for k, v in each.items()}


def read_polarimeter(spark: SparkSession, path: str, polarised: bool = False, swapped: bool = True, intervals: bool = False) -> DataFrame:
    """Samples of polarimeter FITS files; see :func:`polarimeter_samples`."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for p, d in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame({"tod": p} | polarimeter_samples(bytes(d), polarised, swapped, intervals))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "tod string, det long, samp long, dat double, ctime double, dx double, dy double, mask boolean, az double, elev double")


def fits_table(rows: np.ndarray, primary: bool = True) -> bytes:
    """A FITS binary table of a record array with plain numeric columns, after an empty first unit if ``primary``."""
    codes = {"u1": "B", "i2": "I", "i4": "J", "i8": "K", "f4": "E", "f8": "D"}
    kinds = [(n, rows.dtype[n].str[1:]) for n in rows.dtype.names]
    body = rows.astype([(n, f">{k}") for n, k in kinds]).tobytes()
    cards = {"XTENSION": "'BINTABLE'", "BITPIX": 8, "NAXIS": 2, "NAXIS1": len(body) // max(len(rows), 1), "NAXIS2": len(rows), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(kinds)}
    for i, (n, k) in enumerate(kinds, 1):
        cards |= {f"TTYPE{i}": f"'{n}'", f"TFORM{i}": f"'1{codes[k]}'"}

    def unit(cards):
        head = "".join(f"{k:<8}= {v!s:>20}".ljust(80) for k, v in cards.items()) + "END".ljust(80)
        return head.ljust(-(-len(head) // 2880) * 2880).encode("ascii")

    return (unit({"SIMPLE": "T", "BITPIX": 8, "NAXIS": 0}) if primary else b"") + unit(cards) + body + b"\0" * (-len(body) % 2880)


def fits_image(image: np.ndarray, header: dict | None = None) -> bytes:
    """A FITS file with one image, x along the first axis of ``image``."""
    cards = {"SIMPLE": "T", "BITPIX": "-64", "NAXIS": "2", "NAXIS1": str(image.shape[0]), "NAXIS2": str(image.shape[1])} | {k: f"'{v}'" if isinstance(v, str) else repr(v) for k, v in (header or {}).items()}
    head = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards.items()) + "END".ljust(80)
    body = image.T.astype(">f8").tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880).encode("ascii") + body + b"\0" * (-len(body) % 2880)


def bad_files(sources: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, file) of a blacklist (source, file) for the sources asked for; names are compared in small letters without outer underscores."""
    plain = F.lower(F.trim("source", F.lit("_")))
    return sources.select(plain.alias("name")).distinct().join(listed.select(plain.alias("name"), "file"), "name")


def without_blacklisted(paths: DataFrame, blacklist: DataFrame, path: str = "path") -> DataFrame:
    """Paths whose last part isn't in ``blacklist`` (column ``name``), the greatest path of each name, sorted."""
    named = paths.withColumn("name", F.substring_index(path, "/", -1))
    return named.join(blacklist.select("name").distinct(), "name", "left_anti").groupBy("name").agg(F.max(path).alias(path)).orderBy("name")
