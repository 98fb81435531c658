"""The same functions on columns: built-in expressions where Spark has them, Arrow batches elsewhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..errors import Corruption
from . import encoding


def _across(f, kind: str = "long"):
    """A function of a batch's bytes that steps along all values together, the longest first, as a column function.

    f gets the lengths and a function that gives the bytes at one place of the first n values."""

    def mapped(data: pa.Array) -> pa.Array:
        raw = data.cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        held = raw.buffers()[2]
        values = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        begin, size = offsets[:-1][order], size[order]
        out = np.empty(len(raw), np.int64)
        out[order] = f(size, lambda at, n: values[begin[:n] + at])
        return pa.array(out, pa.int64(), mask=np.asarray(raw.is_null()))

    return arrow_udf(mapped, kind)


def _crc(size: np.ndarray, byte) -> np.ndarray:
    rows = np.array(encoding.CRC_ROWS, np.uint32)
    state = np.full(len(size), (1 << 32) - 1, np.uint32)
    for at in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -at, "left"))
        state[:n] = rows[(state[:n] ^ byte(at, n)) & 0xFF] ^ (state[:n] >> 8)
    return state ^ np.uint32((1 << 32) - 1)


def _hash(seed: int):
    def f(size: np.ndarray, byte) -> np.ndarray:
        low = np.uint64((1 << 32) - 1)
        factor = np.uint64(encoding.HASH_FACTOR)
        state = (np.uint64(seed) ^ (size.astype(np.uint64) * factor)) & low
        for at in range(0, int(size[0]) if len(size) else 0, 4):
            live = int(np.searchsorted(-size, -at, "left"))
            word = np.zeros(live, np.uint64)
            for i in range(4):
                n = int(np.searchsorted(-size, -(at + i), "left"))
                word[:n] |= byte(at + i, n).astype(np.uint64) << np.uint64(8 * i)
            part = (state[:live] + word) * factor & low
            state[:live] = part ^ (part >> np.where(size[:live] >= at + 4, 16, 24).astype(np.uint64))
        return state

    return f


def crc32c(data: Column | str) -> Column:
    return _across(_crc)(data)


def masked(crc: Column) -> Column:
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17))
    return (turned + F.lit(encoding.CRC_MASK_DELTA)).bitwiseAND(F.lit((1 << 32) - 1))


def unmasked(masked_crc: Column) -> Column:
    low = F.lit((1 << 32) - 1)
    turned = (masked_crc - F.lit(encoding.CRC_MASK_DELTA)).bitwiseAND(low)
    return F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15)).bitwiseAND(low)


def hash32(data: Column | str, seed: int = encoding.FILTER_SEED) -> Column:
    return _across(_hash(seed))(data)


def _named(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _byte(data: Column, at: Column) -> Column:
    """The value of the byte at a place, counted from 1."""
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("long")


def encode_varint(value: Column | str) -> Column:
    value = _named(value)
    last = varint_length(value) - 1
    group = lambda i: F.call_function("shiftrightunsigned", value, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i < last, 128).otherwise(0)
    return F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(group(i).cast("long")), 2, "0"))))


def varint_size(data: Column | str) -> Column:
    """Bytes of the varint that the data begin with, 0 if none ends within nine."""
    data = _named(data)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.octet_length(data), F.lit(9))), lambda i: _byte(data, i) < 128)
    return F.when(F.octet_length(data) > 0, F.array_position(ends, True)).otherwise(0).cast("int")


def decode_varint(data: Column | str) -> Column:
    """The number, up to 63 bits; null if it is cut off."""
    data = _named(data)
    size = varint_size(data)
    part = lambda i: F.call_function("shiftleft", _byte(data, i).bitwiseAND(F.lit(127)), ((i - 1) * 7).cast("int"))
    return F.when(size > 0, F.aggregate(F.sequence(F.lit(1), size), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(part(i))))


def varint_length(value: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.when(value > 0, F.length(F.bin(value))).otherwise(1) / 7)).cast("int")


def encode_fixed(value: Column, width: int) -> Column:
    """Little-endian, 4 or 8 bytes."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(width))))


def encode_fixed64(value: Column) -> Column:
    return encode_fixed(value, 8)


def decode_fixed(data: Column, width: int) -> Column:
    """Null if cut off. Eight bytes are taken as signed."""
    digits = F.hex(data)
    turned = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))))
    return F.when(F.octet_length(data) >= width, F.conv(turned, 16, -10).cast("long"))


def with_length(data: Column) -> Column:
    return F.concat(encode_varint(F.octet_length(data).cast("long")), data)


def take_with_length(data: Column) -> Column:
    """struct<taken, rest>, or null if cut off."""
    head, size = varint_size(data), decode_varint(data)
    whole = (head > 0) & (F.octet_length(data) >= head + size)
    return F.when(whole, F.struct(F.substring(data, head + 1, size.cast("int")).alias("taken"), F.substring(data, (head + size + 1).cast("int"), F.octet_length(data)).alias("rest")))


def next_random(state: Column) -> Column:
    """Park-Miller: the state after the given one."""
    seed = state.bitwiseAND(F.lit(encoding.LCG_MODULUS))
    return F.when(seed.isin(0, encoding.LCG_MODULUS), 1).otherwise(seed) * encoding.LCG_FACTOR % encoding.LCG_MODULUS


def compare(a: Column, b: Column) -> Column:
    return (a > b).cast("int") - (a < b).cast("int")


def _raised(key: Column, at: Column) -> Column:
    """The key up to the byte at a place (counted from 0), that byte one higher."""
    byte = F.unhex(F.lpad(F.hex(_byte(key, at + 1) + 1), 2, "0"))
    return F.when(at == 0, byte).otherwise(F.concat(F.substring(key, F.lit(1), at), byte))


def separator(a: str, b: str) -> Column:
    """A short key in [a, b)."""
    at = shared_prefix(a, b)
    inside = (at < F.least(F.octet_length(a), F.octet_length(b))) & (_byte(F.col(a), at + 1) + 1 < _byte(F.col(b), at + 1))
    return F.when(inside, _raised(F.col(a), at)).otherwise(F.col(a))


def successor(key: str) -> Column:
    """A short key at or above the given one."""
    tail = F.regexp_extract(F.hex(key), "^(?:FF)*", 0)
    at = F.expr("0") + F.length(tail) / 2
    return F.when(at < F.octet_length(key), _raised(F.col(key), at.cast("int"))).otherwise(F.col(key))


def shortened(user: Column, short: Column, whole: Column) -> Column:
    """An internal key of the shorter user key, before all versions of its own; else the internal key as it was."""
    newest = F.unhex(F.lit("01" + "FF" * 7))
    return F.when((F.octet_length(short) < F.octet_length(user)) & (user < short), F.concat(short, newest)).otherwise(whole)


def block_handle(offset: Column, size: Column) -> Column:
    return F.concat(encode_varint(offset), encode_varint(size))


def read_block_handle(data: Column) -> Column:
    """struct<offset, size, used>, or null if cut off."""
    first = varint_size(data)
    rest = F.substring(data, first + 1, F.octet_length(data))
    found = F.struct(decode_varint(data).alias("offset"), decode_varint(rest).alias("size"), (first + varint_size(rest)).alias("used"))
    return F.when((first > 0) & (varint_size(rest) > 0), found)


def footer(meta: Column, index: Column) -> Column:
    """Two block handles, padded, and the magic number: 48 bytes."""
    digits = F.rpad(F.concat(F.hex(meta), F.hex(index)), 2 * encoding.HANDLES_SIZE, "0")
    return F.concat(F.unhex(digits), F.unhex(F.lit(encoding.encode_fixed(encoding.TABLE_MAGIC, 8).hex())))


def read_footer(data: Column) -> Column:
    """struct<meta, index> of block handles, or null if it is short or its magic number is wrong.

    A file has one footer, so plain Python over Arrow batches will do."""

    def found(data: pa.Array) -> pa.Array:
        handle = pa.struct([("offset", pa.int64()), ("size", pa.int64())])
        return pa.array([_footer_or_none(x) for x in data.to_pylist()], pa.struct([("meta", handle), ("index", handle)]))

    return arrow_udf(found, "struct<meta: struct<offset: long, size: long>, index: struct<offset: long, size: long>>")(data)


def _footer_or_none(data: bytes | None) -> dict | None:
    try:
        handles = encoding.read_footer(data or b"")
    except Corruption:
        return None
    return {name: {"offset": h[0], "size": h[1]} for name, h in zip(("meta", "index"), handles, strict=True)}


def bloom_probes(hashed: Column, bits: Column, k: int) -> Column:
    """The bits of a filter of so many bits that a key with this hash sets."""
    step = F.shiftright(hashed, 17).bitwiseOR(F.shiftleft(hashed, 15).bitwiseAND(F.lit((1 << 32) - 1)))
    return F.array(*((hashed + step * i).bitwiseAND(F.lit((1 << 32) - 1)) % bits for i in range(k)))


def tag(seq: Column, op: Column) -> Column:
    """The packed tag; exact for sequences of up to 55 bits, beyond which a signed long would overflow."""
    return seq * 256 + op


def internal_key(k: Column, seq: Column, op: Column) -> Column:
    return F.concat(k, encode_fixed64(tag(seq, op)))


def user_key(key: str) -> Column:
    return F.expr(f"CASE WHEN octet_length({key}) >= 8 THEN substring({key}, 1, octet_length({key}) - 8) END")


def lookup_key(k: Column, seq: Column) -> Column:
    """What a lookup at a sequence seeks: the internal key with its length before it."""
    return with_length(internal_key(k, seq, F.lit(encoding.VALUE)))


def parsed_internal_key(key: Column) -> Column:
    """struct<k, seq, op>, or null if the key is short or of an unknown kind. Sequences as in ``tag``."""
    n = F.octet_length(key)
    last = decode_fixed(F.substring(key, n - 7, F.lit(8)), 8)
    found = F.struct(F.substring(key, F.lit(1), n - 8).alias("k"), F.shiftright(last, 8).alias("seq"), last.bitwiseAND(F.lit(255)).cast("int").alias("op"))
    return F.when((n >= 8) & (last.bitwiseAND(F.lit(255)) <= encoding.VALUE), found)


def shared_prefix(a: str, b: str) -> Column:
    """Bytes that two binary columns share at their start."""
    n = f"least(octet_length({a}), octet_length({b}))"
    return F.expr(f"coalesce(array_max(filter(sequence(0, coalesce({n}, 0)), n -> left({a}, n) = left({b}, n))), 0)")


def table_name(number: Column) -> Column:
    return F.format_string("%06d.sst", number)


def parsed_name(name: str) -> Column:
    """struct<type, number>, or null for a name of no known kind."""
    kind = (
        f"CASE WHEN {name} IN ('LOG', 'LOG.old') THEN 'info_log' WHEN {name} IN ('CURRENT', 'LOCK') THEN lower({name}) WHEN {name} RLIKE '^MANIFEST-[0-9]*$' THEN 'descriptor' "
        f"WHEN {name} RLIKE '^[0-9]+[.]log$' THEN 'log' WHEN {name} RLIKE '^[0-9]+[.]sst$' THEN 'table' WHEN {name} RLIKE '^[0-9]+[.]dbtmp$' THEN 'temp' END"
    )
    number = f"coalesce(try_cast(regexp_extract({name}, '([0-9]+)', 1) AS decimal(20, 0)), 0)"
    return F.expr(f"CASE WHEN ({kind}) IS NOT NULL THEN struct({kind} AS type, {number} AS number) END")
