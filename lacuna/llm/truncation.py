"""Detecting texts that were cut off by a field limit or a broken transfer.

A stack automaton reads every whole text: elements of markup go on its stack until they are closed, brackets
and quotation marks until they are closed or their paragraph ends, and at the end of the text it stands inside
a tag, an entity, an escape, a multibyte character or a link, or outside all of them. What is left open:

- a construct broken off decides a cut; a bare name of a tag or entity does so if the corpus has whole ones
  that begin like it, nested structure if three levels are open;
- a missing terminator is judged by baselines over all texts: how often the last words end a sentence or line
  anywhere in the corpus, and the length at which each source cuts its texts. An open stack lowers the bar;
- whole sentences with an open stack, or an end in a closing mark, are cuts only at the length of the source's limit.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Characters and words by which posts are written.
TERMINATORS = ".!?。！？…"
CLOSERS = ")]}\"'»”’」』）>*~_"
PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“", "“": "„", "」": "「", "』": "『", "）": "（"}
OPENERS = "([{«“„「『（"
VOID = ("br", "hr", "img", "p", "li", "input")  # elements that are not closed
CUT_MARKS = r"[(<\[](?:more|continued|cont\.?|mehr|suite|más|続き)[)>\]]|(?:…|\.{3})\s*[»›]|\[\s*(?:…|\.{3})\s*\]|(?:…|\.{3})?\s*(?:read more|weiterlesen|lire la suite|leer más)"
DOTS = r"…|\.{3,}"

#: Share of sentence ends among all uses of the last words, below which a missing terminator is a cut.
LEAST_SHARE = 0.04
#: Other texts in 10,000 (but 2 at least) that must end in a phrase for it to be a usual end, with dots or without.
USUAL = 2
#: Levels of brackets and quotation marks that no whole text leaves open.
DEEP = 3
#: Bits of the filter of contexts to count, per candidate text; its size is bounded by ``MOST_BITS``.
BITS, MOST_BITS = 128, 1 << 26


class Reader:
    """The automaton; one per worker process."""

    def __init__(self):
        import regex

        self.tokens = regex.compile(
            r"https?:/[\x21-\x7e]*|[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*|\d+(?:[.,:]\d+)*|\.{3,}|\S"
        ).findall
        self.markup = regex.compile(r"<[^<>\n]*>|\[/?[a-zA-Z*]+(?:=[^\]\n]*)?\]|&(?:[a-zA-Z]+|#\d+|#x[0-9a-fA-F]+);")
        # what moves the stack; of markup the name, and whether it closes
        self.events = regex.compile(rf'<(?P<c>/?)(?P<n>[a-zA-Z]+)[^<>\n]*>|\[(?P<c>/?)(?P<n>[a-zA-Z]+)(?:=[^\]\n]*)?\]|\n\s*\n|["{regex.escape(OPENERS + "".join(PAIRS))}]').finditer
        self.names = regex.compile(r"[<\[]/?[a-zA-Z]+(?=[^<>\[\]\n]*[>\]])|&[a-zA-Z]+(?=;)").findall
        self.invisible = regex.compile("[​‌⁠﻿­]")
        # states inside a construct, as what may follow its first character up to the end of the text
        whole = r'\s+[a-zA-Z][\w:-]*="[^"<>\n]*"'
        self.in_tag = regex.compile(rf'<[/!]?[a-zA-Z]*+(?:{whole})*+(?:\s+(?:/|[a-zA-Z-]*(?:="?[^"<>\s]*|="[^"<>\n]*)?))?').fullmatch
        self.in_code = regex.compile(r"\[/?[a-zA-Z]*+(?:=[^\]\s]*)?").fullmatch
        self.in_entity = regex.compile(r"&(?:#x?[0-9a-fA-F]*|[a-zA-Z]*)").fullmatch
        self.percents = regex.compile(r"(?:%[0-9a-fA-F]{2})+$").search
        self.bare = regex.compile(r"[<\[&]/?[a-zA-Z]*").fullmatch
        self.cjk = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]").match
        self.open_escape = regex.compile(r"(?:\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|%[0-9A-F]{2}%[0-9A-F]?|=[0-9A-F]{2}=[0-9A-F]?|\\)$").search
        self.open_link = regex.compile(r"(?:^|\s)(https?:?/?|htt?)$").search
        self.mark = regex.compile(rf"\s*(?:{CUT_MARKS})\s*$", regex.I).search
        self.dots = regex.compile(rf"\s*(?:{DOTS})\s*$").search
        self.sign = regex.compile(r"^\s*(?:--\s?|—|_{4,}|-{4,}|={4,})\s*$|^\s*~ .* ~\s*$|^\s*- .{0,40} -\s*$").search
        self.breaks = regex.compile(r"(?i)<br\s*/?>|</?p>").sub
        self.word = regex.compile(r"[\p{L}\p{N}<]").match
        self.hexes = regex.compile(r"(?<![0-9a-zA-Z])[0-9a-f]{2,}(?=\.)").sub

    def lines(self, text: str) -> list[str]:
        return [x for x in self.breaks("\n", self.invisible.sub("", text)).replace("\r", "\n").split("\n") if x.strip()]

    def words(self, line: str) -> list[str]:
        return [self.normal(w) for w in self.tokens(unicodedata.normalize("NFKC", self.markup.sub(" ", line)))]

    def normal(self, w: str) -> str:
        if w[0].isdigit():
            return "<n>"
        if w.startswith("http"):
            host, _, path = w.partition("//")[2].partition("/")
            shape = self.hexes("X", path)
            return f"<l>{host.count('.')}/" + "".join("9" if c.isdigit() else c for c in shape).replace("99", "9").replace("99", "9")
        return w.lower()

    def stack(self, text: str) -> list[str]:
        """What a whole text leaves open at its end: names of elements, brackets and quotation marks."""
        stack: list[str] = []
        count: Counter = Counter()  # of each opener on the stack

        def close(opener: str) -> bool:
            """Closes the innermost ``opener`` and all that was opened after it; false if there is none."""
            if not count[opener]:
                return False
            while True:
                count[x := stack.pop()] -= 1
                if x == opener:
                    return True

        for m in self.events(text):
            c, name, opened = m.group(), (m.group("n") or "").lower(), None
            if name:
                if m.group("c"):
                    close(name)
                elif name not in VOID and not c.endswith("/>"):
                    opened = name
            elif c[0] == "\n":  # elements go on, the rest ends with its paragraph
                if any(not x.isalpha() for x in stack):
                    stack = [x for x in stack if x.isalpha()]
                    count = Counter(stack)
            elif c == '"':
                opened = None if close(c) else c
            elif not (c in PAIRS and close(PAIRS[c])) and c in OPENERS:
                opened = c
            if opened:
                stack.append(opened)
                count[opened] += 1
        return stack

    def inside(self, body: str) -> tuple[str, str]:
        """The construct in which a text stops: ``("cut", "")``, ``("part", bare name)`` of one, or ``("", "")``."""
        if m := self.percents(body[-12:]):
            try:
                bytes.fromhex(m.group().replace("%", "")).decode()
            except UnicodeDecodeError as e:
                if e.reason == "unexpected end of data":
                    return "cut", ""
        if body[-1] == "\ufffd" or self.open_link(body[-12:]) or self.open_escape(body[-12:]):
            return "cut", ""
        for first, state in (("<", self.in_tag), ("[", self.in_code), ("&", self.in_entity)):
            at = body.rfind(first)  # the later ones lie inside no construct that an earlier one opened
            if at >= 0 and state(body, at):
                return ("part", body[at:].lower()) if self.bare(body, at) and body[at + 1 : at + 2] != "/" else ("cut", "")
        return "", ""

    def end(self, text: str | None) -> tuple[str, list[str], str]:
        """How a text ends: (state, words of its last line up to the end, mark).

        States: ``whole`` (nothing open), ``cut`` (structure broken off), ``part`` (of a tag or entity), ``mark`` (a
        mark of a cut), ``dots``, ``open`` (no terminator), ``link`` (ends with a link), ``held`` (ends well, but with an
        open stack), ``closed`` (ends in a closing mark).
        """
        body = (text or "").rstrip()
        if not body:
            return "whole", [], ""
        state, name = self.inside(body)
        if state:
            return state, [name] if name else [], ""
        stack = self.stack(body)
        if sum(not x.isalpha() for x in stack) >= DEEP:
            return "cut", [], ""
        whole = "held" if stack else "whole"
        lines = self.lines(body)
        if not lines or any(self.sign(x) for x in lines[-3:]):
            return "whole", [], ""
        last = lines[-1]
        if body.lower().endswith(("[/quote]", "</blockquote>", "</q>")):
            return "whole", [], ""
        if last.lstrip().startswith((">", "|")) and (self.mark(last) or self.dots(last)):
            return "whole", [], ""  # the quoted text was cut, not the post
        if m := self.mark(last):
            words = self.words(last[: m.start()])
            return ("whole", [], "") if words and words[-1][-1] in TERMINATORS else ("mark", words[-9:], "mark")
        if m := self.dots(last):
            return "dots", self.words(last[: m.start()])[-9:], "dots"
        if body[-1] in ">]" and self.markup.search(body[-210:]) and not self.words(last):
            return "whole", [], ""
        words = self.words(last)
        if not words:
            return "whole", [], ""
        w = words[-1]
        if w.startswith("<l>"):
            return "link", words[-9:], ""
        if w[-1] in TERMINATORS:
            return whole, [], ""
        if w in CLOSERS and w != "'":
            return whole if len(words) > 1 and words[-2][-1] in TERMINATORS else "closed", [], ""
        if not self.word(w):
            glued = w not in "-–/=+" or not body[-2:-1].isspace()
            return ("cut", [], "") if w in ",;:([{«“„¿¡&'’-–/=+" and glued else (whole, [], "")
        return "open", words[-9:], "open" if stack else ""


def _key(kind: str, words: list[str]) -> int:
    return xxhash.xxh64_intdigest(kind + "\x1f" + "\x1f".join(words)) - (1 << 63)


def contexts(words: list[str], cjk: bool) -> list[int]:
    """Keys of the contexts of a last word: itself with 3, 2, 1 and 0 words before it, then any word after 2 and 1 words.

    In writing without blanks every character is a word here; there a context is twice as long.
    """
    each = 2 if cjk else 1
    out = [_key("w", words[-n * each :]) if len(words) >= n * each else 0 for n in (4, 3, 2, 1)]
    after_word = len(words) > 1 and (words[-2][0].isalnum() or words[-2][0] == "<")
    return out + [_key("o", words[-n * each - 1 : -1]) if after_word and len(words) > n * each else 0 for n in (2, 1)]


def count_text(reader: Reader, text: str | None, tally: dict[int, list[int]], wanted, vocabulary: Counter) -> None:
    """Adds the ends and inner uses of all wanted contexts of a whole text to ``tally``."""
    text = text or ""
    vocabulary.update(x.lower() for x in reader.names(text))
    for line in reader.lines(text):
        words = reader.words(line)
        n = len(words)
        vocabulary.update(words[:-1])
        for i, w in enumerate(words):
            if not reader.word(w):
                continue
            nxt = words[i + 1] if i + 1 < n else ""
            dotted = nxt.startswith("...") or nxt == "…"
            final = not nxt or nxt[0] in TERMINATORS
            if not final and not (reader.word(nxt) or nxt in ",;:"):
                continue
            for k in contexts(words[max(0, i - 8) : i + 1], bool(reader.cjk(w))):
                if k and wanted(k):
                    t = tally.setdefault(k, [0, 0])
                    t[0 if final else 1] += 1
            if dotted:
                k = _key("d", words[max(0, i - 1) : i + 1])
                if wanted(k):
                    tally.setdefault(k, [0, 0])[0] += 1


def beginnings(word: str) -> list[int]:
    """Keys of what a longer word, or a whole tag or entity, begins with."""
    if word[0].isalpha():
        return [_key("p", [word[:k]]) for k in range(1, len(word))]
    return [_key("t", [word[:k]]) for k in range(1, len(word) + 1)] if word[0] in "<[&" and word != "<n>" else []


def candidate(reader: Reader, text: str | None) -> tuple[str, list[int]]:
    """``(state, keys)`` of a text; the keys are those of ``contexts``, then dots, then prefix of a longer word, then part of a tag or entity."""
    state, words, mark = reader.end(text)
    if state == "part":
        return state, [0] * 8 + [_key("t", words)]
    if state in ("whole", "cut", "held", "closed") or not words:
        return state, []
    prefix = _key("p", [words[-1]]) if words[-1][0].isalpha() else 0
    return state + ("+" if mark == "open" else ""), contexts(words, bool(reader.cjk(words[-1]))) + [_key("d", words[-2:]), prefix]


def decide(state: str, uses: list[tuple[int, int]], at_limit: bool, near_limit: bool, posts: int = 0) -> bool:
    """Whether a text is cut; ``uses`` are (ends, inner uses) of the keys of ``candidate`` in so many ``posts``, itself included."""
    usual = max(USUAL, USUAL * posts / 10_000)
    if state == "cut":
        return True
    if state == "part":
        return at_limit or uses[8][0] > 0
    if state in ("held", "closed"):
        return at_limit
    if state == "whole" or not uses:
        return False
    if state == "mark":
        return True
    if state == "link":
        return at_limit or uses[3][1] < usual
    share = end_share(uses)
    ends, inner = uses[2][0] - 1, uses[2][1]  # of the same two last words in other places
    used_to_end = ends >= 6 and ends >= 0.01 * (ends + inner)
    word, longer = uses[3][0] - 1 + uses[3][1], uses[7][0]
    # where the word before goes on very often, cuts behind the same first letters meet by chance, but not with all words before
    phrase = next((u[0] - 1 for u in uses[:2] if u != (0, 0)), ends)
    rare_end = ends < usual or (ends < 0.001 * uses[5][1] and phrase < usual)
    broken = longer >= 3 and word <= 0.02 * longer and rare_end
    if state == "dots":
        deliberate = uses[6][0] - 1 >= usual
        return (share < LEAST_SHARE and not used_to_end) or (not deliberate and (near_limit or broken))
    if at_limit or broken:
        return True
    return share < (LEAST_SHARE if state == "open" else 0.2) and not used_to_end


def end_share(uses: list[tuple[int, int]], prior: float = 0.2, weight: float = 5.0) -> float:
    """Share of ends after the last words: wider contexts smooth narrower ones.

    The text's own end is left out.
    """

    def smooth(k: int, p: float) -> float:
        ends, inner = max(0, uses[k][0] - 1), uses[k][1]
        return (ends + weight * p) / (ends + inner + weight)

    after_one = smooth(5, prior)
    p = after_one
    for k in (3, 2, 1, 0):
        p = smooth(k, p)
    # what the two words before let expect, whatever the last word
    return (p * smooth(4, after_one)) ** 0.5 if uses[4] != (0, 0) else p


class Filter:
    """The keys that candidate texts ask for, as one bit each of their hash; may pass others, never loses one."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, len(bits) * 8 - 1

    def __call__(self, key: int) -> bool:
        at = key & self.mask
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


def wanted_keys(candidates: DataFrame) -> np.ndarray:
    """Bit filter over all keys of the candidates: per-partition filters, OR-merged in rounds of 16."""
    n = candidates.where(F.size("keys") > 0).count()
    size = 1 << max(16, min(MOST_BITS, n * BITS).bit_length())

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bits = np.zeros(size // 8, np.uint8)
        for b in batches:
            for keys in b["keys"]:
                at = np.asarray(keys, dtype=np.int64) & (size - 1)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "bits": [bits.tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // 16], "bits": [bits.tobytes()]})

    parts = candidates.rdd.getNumPartitions()
    filters = candidates.select("keys").mapInPandas(build, "part int, bits binary")
    while parts > 1:
        filters = filters.groupBy((F.col("part") / 16).cast("int").alias("_g")).applyInPandas(merge, "part int, bits binary")
        parts = -(-parts // 16)
    row = filters.first()
    return np.frombuffer(row["bits"], np.uint8) if row else np.zeros(size // 8, np.uint8)


def source_limits(lengths: DataFrame) -> DataFrame:
    """``(source, unit, cap)``: the length at which most of a source's texts pile up.

    A length may be the limit if at least 3 texts have it, five times as many as the 50 lengths below it on
    average, and at most a tenth of the source's texts are longer. Works on counts per length.
    """
    counts = lengths.groupBy("source", "unit", "len").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("source", "unit")
    below = own.orderBy("len").rangeBetween(-50, -1)
    longer = own.orderBy("len").rangeBetween(1, Window.unboundedFollowing)
    piled = counts.select(
        "source", "unit", "len", "n",
        F.coalesce(F.sum("n").over(below), F.lit(0)).alias("_below"),
        F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("_longer"),
        F.sum("n").over(own).alias("_all"),
    )
    return piled.where("n >= 3 AND n >= 5 * _below / 50 AND _longer <= 0.1 * _all").groupBy("source", "unit").agg(F.max_by("len", F.struct("n", "len")).alias("cap"))


def truncated(documents: DataFrame, key: str, scratch) -> DataFrame:
    """``(key, source, cut)`` for every row of ``documents`` (key, source, text): whether its text was cut off.

    Null, empty and blank texts are not cut. A null source is a source. Whole texts are read, twice: once
    for their ends, once to count the uses of the words that end a candidate, by hash, with the counts
    added up before the shuffle. Repeated texts count each time. An empty table gives an empty result.
    Broadcast: one bit filter of at most 2 * ``MOST_BITS`` bits; beyond that it lets more keys pass, nothing is lost.
    """
    kind = documents.schema[key].dataType.simpleString()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for b in batches:
            found = [candidate(reader, t) for t in b["text"]]
            yield pd.DataFrame(
                {
                    key: b[key], "source": b["source"], "state": [x for x, _ in found], "keys": [k for _, k in found],
                    "chars": [len(t or "") for t in b["text"]], "bytes": [len((t or "").encode("utf-8", "replace")) for t in b["text"]],
                }
            )

    texts = documents.select(key, "source", "text")
    posts = scratch.write(texts.mapInPandas(ends, f"`{key}` {kind}, source string, state string, keys array<long>, chars long, bytes long"), "ends")
    total = posts.where("chars > 0").count()
    sent = documents.sparkSession.sparkContext.broadcast(wanted_keys(posts))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, wanted = Reader(), Filter(sent.value)
        tally: dict[int, list[int]] = {}
        words: Counter = Counter()

        def flush() -> pd.DataFrame:
            for w, c in words.items():
                for h in beginnings(w):
                    if wanted(h):
                        tally.setdefault(h, [0, 0])[0] += c
            keys = np.fromiter(tally.keys(), np.int64, len(tally))
            pairs = np.array(list(tally.values()), dtype=np.int64).reshape(len(keys), 2)
            tally.clear()
            words.clear()
            return pd.DataFrame({"k": keys, "ends": pairs[:, 0], "inner": pairs[:, 1]})

        for b in batches:
            for t in b["text"]:
                count_text(reader, t, tally, wanted, words)
                if len(tally) + len(words) > 500_000:
                    yield flush()
        yield flush()

    uses = documents.select("text").mapInPandas(count, "k long, ends long, inner long").groupBy("k").agg(F.sum("ends").alias("ends"), F.sum("inner").alias("inner"))
    asked = posts.where(F.size("keys") > 0).select(key, F.posexplode("keys").alias("place", "k"))
    # a key that nothing counted, like key 0 of a missing context, has no uses
    answered = (
        asked.where("k <> 0").join(uses, "k").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("ends", "inner")))).alias("uses"))
    )
    lengths = posts.where("chars > 0").select("source", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("unit", "len"))
    caps = source_limits(lengths).groupBy("source").agg(*[F.max(F.when(F.col("unit") == u, F.col("cap"))).alias(f"{u}_cap") for u in ("chars", "bytes")])
    judged = (
        posts.alias("p").join(caps.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
        .select(key, "p.source", "state", "chars", "bytes", "chars_cap", "bytes_cap")
        .join(answered, key, "left")
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            verdicts = []
            for state, n, m, cap, byte_cap, found in zip(b["state"], b["chars"], b["bytes"], b["chars_cap"], b["bytes_cap"], b["uses"]):
                found = {p: (u["ends"], u["inner"]) for p, u in dict(found).items()} if found is not None else {}
                uses = [found.get(i, (0, 0)) for i in range(9)] if state not in ("whole", "cut", "held", "closed") else []
                at_limit = n == cap or (byte_cap == byte_cap and byte_cap is not None and byte_cap - 3 <= m <= byte_cap)
                near = cap == cap and cap is not None and cap - 16 <= n <= cap
                verdicts.append(decide(state, uses, bool(at_limit), bool(near), total))
            yield pd.DataFrame({key: b[key], "source": b["source"], "cut": verdicts})

    return judged.mapInPandas(judge, f"`{key}` {kind}, source string, cut boolean")


def rates(verdicts: DataFrame) -> DataFrame:
    """``(source, posts, cut, rate)``: how often each source cuts its texts."""
    cut = F.sum(F.col("cut").cast("long"))
    return verdicts.groupBy("source").agg(F.count(F.lit(1)).alias("posts"), cut.alias("cut"), F.round(cut / F.count(F.lit(1)), 6).alias("rate"))
