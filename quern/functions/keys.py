"""Identities as column functions: digests, scores, fingerprints, keys and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def score_hex(seed: str | Column, key: Column, separator: str = ":") -> Column:
    """16 hexadecimal digits that order keys as their seeded score does."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return F.substring(F.sha2(F.concat(seed, F.lit(separator), key), 256), 1, 16)


def score(seed: str | Column, key: Column) -> Column:
    """The unsigned 64-bit score as a decimal."""
    return F.conv(score_hex(seed, key), 16, 10).cast("decimal(20,0)")


def threshold_hex(fraction: float) -> str:
    """The score below which this fraction of all scores lies, as hexadecimal digits."""
    return f"{int(fraction * 2**64):016x}"


def group_id(kind: str, hexdigest: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(hexdigest, 1, 20))


def episode_key(repository: Column, index: Column) -> Column:
    return F.format_string("%s/episode_%06d", repository, index)


def chunk(index: Column, size: int = 1000) -> Column:
    return F.floor(index / size).cast("long")


def canonical_json_digest(*fields: Column) -> Column:
    """Digest of tight JSON with its fields in the order of their names, which the caller gives."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def length_prefixed(content: Column) -> Column:
    """Bytes after their length as 8 big-endian bytes, for digests over several files."""
    return F.concat(F.unhex(F.lpad(F.hex(F.length(content)), 16, "0")), content)


def cache_key(key: Column) -> Column:
    return F.substring(F.sha1(key.cast("binary")), 1, 16)


def path_tokens(path: Column) -> Column:
    """Lower-case text with every run of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.lower(path), "[^a-z0-9]+", "_")


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def lines_digest(lines: Column) -> Column:
    """Digest of an array of lines, each with a line feed behind it."""
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256)


def nul_digest(name: Column, hashes: Column) -> Column:
    """Digest of names and their hashes, each with a zero byte behind it: of arrays of equal length, the hashes arrays of strings."""
    zero = F.lit(b"\x00")
    put = lambda acc, x: F.concat(acc, x.cast("binary"), zero)
    pairs = F.arrays_zip(name.alias("n"), hashes.alias("h"))
    return F.sha2(F.aggregate(pairs, F.lit(b""), lambda acc, p: F.aggregate(p["h"], put(acc, p["n"]), put)), 256)


def duration(seconds: Column) -> Column:
    """DD:HH:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)
