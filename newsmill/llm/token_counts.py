"""Exact BPE token counts of every prefix of a text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from newsmill.llm.common import pick

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Known(dict):
    """Counts of pieces; a piece that is not known yet counts 0 and is noted."""

    def __init__(self) -> None:
        self.unknown: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.unknown.append(piece)
        return 0


class PrefixCounter:
    """Token counts of all prefixes, by dynamic programming over a BPE vocabulary.

    Of a piece's encodings only one has no pair of neighbours that the merges would have
    joined otherwise.  So the encoding of a prefix ends in the one token whose left neighbour,
    the last token of the prefix before it, stands beside it: a prefix's count is that
    prefix's count plus one.  Pieces are looked up in sorted order and share the states of
    their common beginnings.
    """

    def __init__(self, path: str, cache: int = 1_000_000) -> None:
        import regex

        model = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.tokens: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for merge in model["model"]["merges"]:  # ids here are merge ranks, whatever the file's are
            left, right = (as_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = self.tokens[left], self.tokens[right]
            self.joined[pair] = len(self.parts)
            self.tokens.setdefault(left + right, len(self.parts))
            self.parts.append(pair)
        self.longest = max(map(len, self.tokens))
        special = [t["content"] for t in model.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)
        self.beside: dict[tuple[int, int], bool] = {}
        self.counts = _Known()
        self.cache = cache

    def _may_stand(self, a: int, b: int) -> bool:
        """Would the merges leave a and b as neighbours?  Undo the later of the two merges
        again and again; no join across the border may come before what has been undone."""
        limit = len(self.parts)
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            if a > b:
                if a < 256:
                    return True
                limit, a = a, self.parts[a][1]
            else:
                if b < 256:
                    return True
                limit, b = b + 1, self.parts[b][0]

    def _extend(self, piece: bytes, last: list[int], count: list[int], start: int) -> None:
        """States of the prefixes longer than ``start``; those up to it are known."""
        beside, tokens = self.beside, self.tokens
        for end in range(start + 1, len(piece) + 1):
            for at in range(max(0, end - self.longest), end):
                token = tokens.get(piece[at:end])
                if token is None:
                    continue
                if at:
                    pair = last[at], token
                    fits = beside.get(pair)
                    if fits is None:
                        if len(beside) > self.cache:
                            beside.clear()
                        fits = beside[pair] = self._may_stand(*pair)
                    if not fits:
                        continue
                last.append(token)
                count.append(count[at] + 1)
                break

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of one piece, the empty one included."""
        last, count = [-1], [0]
        self._extend(piece, last, count, 0)
        return count

    def _learn(self, pieces: set[str]) -> None:
        last, count, before = [-1], [0], b""
        for piece, name in sorted((p.encode(), p) for p in pieces):
            keep, most = 0, min(len(piece), len(before))
            while keep < most and piece[keep] == before[keep]:
                keep += 1
            del last[keep + 1 :], count[keep + 1 :]
            self._extend(piece, last, count, keep)
            before = piece
            self.counts[name] = count[-1]

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        split, known = self.split.findall, self.counts
        if len(known) > self.cache:
            known.clear()
        sums, later = [], []
        for text in texts:
            pieces, n = [text], 0
            if self.special and self.special.search(text):
                parts = list(self.segments(text))
                pieces = [s for s, is_special in parts if not is_special]
                n = len(parts) - len(pieces)
            for plain in pieces:
                n += sum(map(known.__getitem__, split(plain)))
            sums.append(n)
            later.append(known.unknown)
            known.unknown = []
        self._learn({piece for pieces in later for piece in pieces})
        return [n + sum(map(known.__getitem__, pieces)) for n, pieces in zip(sums, later)]

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:0], text[:1], ..., the whole text: what an encoder would return
        for each of these prefixes."""
        out = [0]
        for segment, is_special in self.segments(text):
            base = out[-1]
            if is_special:
                for i in range(1, len(segment)):  # a part of a special string is plain text
                    out.append(self.totals([text[: len(out)]])[0])
                out.append(base + 1)
                continue
            start, blanks = base, 0  # count before, and length of, a run of blanks just read
            for m in self.split.finditer(segment):
                piece = m[0]
                whole = start
                data = piece.encode()
                sizes = accumulate(len(c.encode()) for c in piece)
                counts = self.piece_counts(data)
                prefix = [counts[s] for s in sizes]
                for i in range(1, len(piece) + 1):
                    part = piece[:i]
                    if blanks and i == 1 and part.isspace():
                        # at the end of a text the blank belongs to the run before it
                        run = segment[m.start() - blanks : m.start() + 1]
                        out.append(self._before_run + self.piece_counts(run.encode())[-1])
                    elif i < len(piece) and piece[0] == "'" and len(self.split.findall(part)) > 1:
                        out.append(whole + sum(self.piece_counts(p.encode())[-1] for p in self.split.findall(part)))
                    else:
                        out.append(whole + prefix[i - 1])
                self._before_run = whole
                blanks = len(piece) if piece.isspace() else 0
                start = whole + prefix[-1]
            if segment:
                out[-1] = start
        return out


def _counter(path: str) -> PrefixCounter:
    """One counter a vocabulary and worker process, kept between its tasks."""
    kept = vars(PrefixCounter).get("kept") or {}
    if path not in kept:
        kept[path] = PrefixCounter(path)
        PrefixCounter.kept = kept
    return kept[path]


def _slices(texts: list[str], chars: int = 1 << 23) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_counts(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    prefixes: bool = False,
) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers library's JSON format,
    on every executor.  With ``prefixes`` there is also prefix_tokens, an array whose element i
    (from 0) is the count of the text's first i characters; ``fits`` and ``tokens_up_to``
    answer from it.  A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and null
    ids give a row each.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _counter(vocabulary)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            totals = [n for part in _slices(texts) for n in counter.totals(part)]
            columns = [
                batch.column(0),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array([n > limit for n in totals], pa.bool_()),
            ]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            if prefixes:
                columns.append(pa.array([counter.prefix_counts(t) for t in texts], pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.record_batch(columns, names)

    texts = pick(df, doc_id=id_col, text=text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return texts.mapInArrow(each, schema + ", prefix_tokens array<int>" * prefixes)


def tokens_up_to(counts: DataFrame, chars: int, name: str = "tokens") -> DataFrame:
    """Tokens of each text cut after ``chars`` characters, from prefix_tokens alone."""
    at = F.least(F.lit(chars), F.size("prefix_tokens") - 1)
    return counts.withColumn(name, F.get("prefix_tokens", at))


def fits(counts: DataFrame, budget: int, name: str = "chars") -> DataFrame:
    """The longest prefix of each text, in characters, that ``budget`` tokens pay for, from
    prefix_tokens alone.  (A longer prefix can have fewer tokens than a shorter one.)"""
    paid = F.filter(
        F.sequence(F.lit(0), F.size("prefix_tokens") - 1),
        lambda i: F.get("prefix_tokens", i) <= budget,
    )
    return counts.withColumn(name, F.array_max(paid))
