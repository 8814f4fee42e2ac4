"""IDL save files: variables as numpy arrays and dictionaries, and the scans in them as samples.

A file is 'SR', a format number, and records: kind i32, place of the next record u32 (and
its high word), four unused bytes.  A variable record has a name, a type and, after the
mark 7, the data.  All is big-endian, and everything ends at a multiple of 4.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Types by their code; whole numbers of two bytes stand in four.
KINDS = {1: ">u1", 2: ">i2", 3: ">i4", 4: ">f4", 5: ">f8", 6: ">c8", 9: ">c16", 12: ">u2", 13: ">u4", 14: ">i8", 15: ">u8"}
VARIABLE, END, ARRAY, STRUCTURE = 2, 6, 4, 32


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.data, self.at - 4)[0]

    def raw(self, size: int) -> bytes:
        out = self.data[self.at : self.at + size]
        self.at += -(-size // 4) * 4
        return out

    def string(self) -> str:
        return self.raw(self.int()).decode("latin-1")

    def dims(self) -> tuple[int, ...]:
        if self.int() != 8:
            raise ValueError("an array description of another kind")
        self.at += 12  # bytes of an element, of all, number of elements
        many = self.int()
        self.at += 8
        most = self.int()
        return tuple(self.int() for _ in range(most))[:many][::-1]

    def kind(self) -> dict:
        """Type code, dimensions if an array, tags if a structure."""
        code, flags = self.int(), self.int()
        out: dict = {"code": code}
        if flags & (ARRAY | STRUCTURE):
            out["dims"] = self.dims()
        if flags & STRUCTURE:
            out["tags"] = self.tags()
        return out

    def tags(self) -> list[tuple[str, dict]]:
        if self.int() != 9:
            raise ValueError("a structure description of another kind")
        self.string()
        known, many = self.int(), self.int()
        self.int()
        if known & 1:
            raise ValueError("a structure that refers to an earlier one")
        table = [(self.int(), self.int(), self.int())[1:] for _ in range(many)]
        names = [self.string() for _ in range(many)]
        kinds: list[dict] = [{"code": code} for code, _ in table]
        for kind, (_, flags) in zip(kinds, table, strict=True):
            if flags & ARRAY:
                kind["dims"] = self.dims()
        for kind, (_, flags) in zip(kinds, table, strict=True):
            if flags & STRUCTURE:
                kind["tags"] = self.tags()
        return list(zip(names, kinds, strict=True))

    def value(self, kind: dict):
        if "tags" in kind:
            many = int(np.prod(kind.get("dims", (1,))))
            return [{n: self.value(k) for n, k in kind["tags"]} for _ in range(many)]
        many = int(np.prod(kind["dims"])) if "dims" in kind else 1
        code = kind["code"]
        if code == 7:
            out = np.array([self.raw(self.int()).decode("latin-1") if self.int() else "" for _ in range(many)])
        else:
            of = np.dtype(KINDS[code])
            if code == 1:
                self.int()  # number of bytes
            if of.itemsize == 2:
                out = np.frombuffer(self.raw(4 * many), of)[1::2]
            else:
                out = np.frombuffer(self.raw(of.itemsize * many), of)
            out = out.astype(of.newbyteorder("="))
        return out.reshape(kind["dims"]) if "dims" in kind else out[0]


def parse(data: bytes) -> dict:
    """All variables of a file, names in small letters; a structure is a list of dictionaries."""
    if data[:2] != b"SR" or data[2:4] != b"\x00\x04":
        raise ValueError("not an uncompressed IDL save file")
    out, at = {}, 4
    while at < len(data):
        kind, low, high = struct.unpack_from(">iII", data, at)
        if kind == END:
            break
        if kind == VARIABLE:
            r = Reader(data, at + 16)
            name, of = r.string().lower(), r.kind()
            if r.int() != 7:
                raise ValueError("a variable without its data")
            out[name] = r.value(of)
        at = low + (high << 32)
    return out


def scan_samples(scan: dict) -> dict[str, np.ndarray]:
    """Samples of a scan's arrays: detectors that are never a number are left out, gaps are filled on a line, angles are in radians.

    ``cut``: a filled sample; ``turn``: the sample before another subscan begins.
    """
    signal = np.asarray(scan["SIGNAL_PLW"], float)
    good = np.flatnonzero(~np.isnan(signal).all(axis=1))
    signal = signal[good]
    n = signal.shape[1]
    missing = np.isnan(signal)
    filled = np.array([np.interp(np.arange(n), np.flatnonzero(~m), row[~m]) for row, m in zip(signal, missing, strict=True)]).reshape(len(good), n)
    ra = np.asarray(scan["XRA_BOLOS_PLW"], float)[good]
    if ra.size and ra[0, 0] < 0:
        ra = ra + 360
    sub = np.asarray(scan["IND_SUBSCANS"])
    turn = np.append(np.diff(sub) != 0, False)
    each = lambda x: np.tile(np.asarray(x), len(good))
    out = {"det": np.repeat(good, n).astype(np.int64), "samp": each(np.arange(n)), "ctime": each(np.asarray(scan["TIME_S"], float)), "dx": np.radians(ra).ravel(), "dy": np.radians(np.asarray(scan["YDEC_BOLOS_PLW"], float)[good]).ravel(), "dat": filled.ravel(), "cut": missing.ravel(), "subscan": each(sub).astype(np.int64), "turn": each(turn)}
    out["elev"] = each(np.broadcast_to(np.asarray(scan["ELEV"], float), n)) if "ELEV" in scan else np.full(len(out["det"]), np.nan)
    return out


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Samples of the scans in IDL save files; see :func:`scan_samples`.  A file without a scan has none."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for p, d in zip(frame["path"], frame["content"], strict=True):
                for scan in parse(bytes(d)).get("scan", []):
                    yield pd.DataFrame({"tod": p} | scan_samples(scan))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "tod string, det long, samp long, ctime double, dx double, dy double, dat double, cut boolean, subscan long, turn boolean, elev double")
