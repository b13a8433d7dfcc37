"""Text rules as Column expressions, and the description parser."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    """A directory name: letters, digits, ``-`` and ``_`` stay, anything else becomes ``_``."""
    return F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("unnamed")), r"[^\p{L}\p{N}_-]", "_")


def truncate(text: Column, longest: int) -> Column:
    return F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest - 1), F.lit("…"))).otherwise(text)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def content_hash(content: Column, first_bytes: int) -> Column:
    """SHA-256 of the first bytes, in hex."""
    return F.sha2(F.substring(content, 1, first_bytes), 256)


def dedup_phrases(phrases: Column) -> Column:
    """Different phrases (letter case aside) in the order of their first use, blank ones left out."""
    tidy = F.filter(F.transform(phrases, _strip), lambda p: p != "")
    lower = F.transform(tidy, F.lower)
    return F.filter(tidy, lambda p, i: F.array_position(lower, F.lower(p)) == i + 1)


def combine_labels(labels: Column, cluster: Column) -> Column:
    """The first two different labels joined, or ``Cluster N``."""
    two = F.array_join(F.slice(labels, 1, 2), "; ")
    return F.when(F.size(labels) > 0, two).otherwise(F.concat(F.lit("Cluster "), cluster.cast("string")))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def hierarchy_groups(text: Column) -> Column:
    """``ARRAY<STRUCT<parent, children>>`` of ``a: x, y | b: z`` or of a flat comma list.

    Groups are split at ``|``, parent and children at the first colon, children at commas; a parent
    without children is its own child, a group without parent is dropped. A flat list (no ``|`` and no
    colon) has one parent per item; a ``|`` group without colon is one parent, commas and all.
    """
    flat = ~F.contains(text, F.lit("|")) & ~F.contains(text, F.lit(":"))
    groups = F.when(flat, F.split(text, ",")).otherwise(F.split(text, r"\|"))

    def one(g: Column) -> Column:
        parent = _strip(F.regexp_extract(g, r"^([^:]*)", 1))
        rest = F.regexp_extract(g, r"(?s)^[^:]*:(.*)$", 1)
        children = F.filter(F.transform(F.split(rest, ","), _strip), lambda c: c != "")
        return F.struct(parent.alias("parent"), F.when(F.size(children) > 0, children).otherwise(F.array(parent)).alias("children"))

    return F.filter(F.transform(groups, one), lambda g: g["parent"] != "")


_LABEL = re.compile(r"^[^\S\n]*(common|variation):", re.I | re.M)


def parse_description(text: str | None) -> tuple[str, str]:
    """``(common, variation)`` of a service's answer.

    A line that starts with a label (any case, bold or not) opens its part, which goes on to the next
    label; text before the first label does not count. Without labels, or with empty ones only, the
    whole answer is the common part.
    """
    plain = "\n".join((text or "").replace("**", "").replace("__", "").splitlines()).strip()
    pieces = _LABEL.split(plain)
    parts: dict[str, list[str]] = {"common": [], "variation": []}
    for label, body in zip(pieces[1::2], pieces[2::2]):
        parts[label.lower()] += [line.strip() for line in body.split("\n") if line.strip()]
    common, variation = (" ".join(parts[k]) for k in ("common", "variation"))
    return (common, variation) if common or variation else (plain, "")
