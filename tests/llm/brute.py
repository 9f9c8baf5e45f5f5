"""Plain Python counterparts of what the queries promise."""

import zlib

import pyarrow.dataset as ds

BLANKS = b" \t\n\x0b\x0c\r"


def rows(folder, name="documents"):
    return ds.dataset(f"{folder}/{name}.parquet", format="parquet", exclude_invalid_files=True).to_table().to_pylist()


def words(text):
    return (text or "").encode().split()


def fold(doc_id, k):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % k
