"""SentencePiece encoding and decoding by a table of prefixes, for merge-type (BPE) models with an identity normaliser.

A sequence of pieces is what merging gives exactly if each two neighbours are
what merging gives for them alone. So every prefix of a text has one last piece:
of the pieces that end there, the one that is compatible with the last piece of
the prefix before it. An Aho-Corasick automaton names the pieces that end at each
character, compatibility is a test by merging the two pieces' characters (kept
in a table), and the ids follow backwards from the end. The work is linear in
the text, whatever it holds.

Where the vocabulary shows that no piece spans them (before a run of space marks,
before punctuation), texts are cut; the cuts' ids are independent, and repeated
cuts are looked up.

Nulls count as empty; the empty text has no ids and decodes to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import pieces, small_batches, tidy

SPACE = "▁"
#: Pairs, and bytes of cuts with their ids and surfaces, that a worker keeps. Beyond, pairs begin anew, and of the cuts those go that were not looked up in the last half.
CACHE, CACHE_BYTES = 400_000, 208 << 20


class PrefixTable:
    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unk = sp.unk_id()
        self.of_byte = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(n) if i not in self.byte_of and i not in self.control and i != self.unk]
        self.id_of = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.pattern = re.compile(self._cut_pattern())
        #: What a piece adds to a text, but for byte pieces.
        self.surface = [p.replace(SPACE, " ") for p in self.piece]
        order = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        #: When a piece is made: pieces of a better score first; characters are there from the start.
        self.rank = {p: order[x] for p, x in self.score.items() if len(p) > 1}
        #: The two pieces of which merging makes a longer one, last.
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            # A piece that merging its own characters doesn't give is never part of a result.
            if len(p) == 1 or self.merge(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pair: dict[tuple[str, str], bool] = {}
        self.text_ids: dict[str, str] = {}
        self.text_back: dict[str, str] = {}
        self.old_ids: dict[str, str] = {}
        self.old_back: dict[str, str] = {}
        self.text_bytes = 0

    def _cut_pattern(self) -> str:
        """Cuts before runs of space marks, and before characters that no piece has after one of another kind (the space mark apart), such as punctuation after a letter."""
        pairs = {(p[k], p[k + 1]) for p in self.id_of for k in range(len(p) - 1)}
        pairs = {(a, b) for a, b in pairs if a != SPACE}
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        while worse := {b for a, b in pairs if b in marks and a not in marks}:
            marks -= worse
        if not marks:
            return f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        m = "".join(map(re.escape, sorted(marks)))
        return f"{SPACE}+[{m}]*[^{SPACE}{m}]*|[{m}]+[^{SPACE}{m}]*"

    def merge(self, text: str) -> list[str]:
        """Best score first, leftmost of ties; keeps the halves of what it makes."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if at < 0:
                return parts
            if len(parts) == 2:
                self.halves[parts[0] + parts[1]] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the characters of both pieces gives the two of them: undo their merges, the latest first, and see whether one across the border would have come earlier."""
        rank, halves = self.rank, self.halves
        limit = len(rank) + 1
        while True:
            across = rank.get(a + b)
            if across is not None and across < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, halves[a][1]
            else:  # of equal ranks the left one is merged first, so the right one is undone first
                limit, b = rb + 1, halves[b][0]

    def split(self, text: str) -> list[str]:
        """The pieces of a text that has its space marks; a character without a piece stands for itself."""
        n = len(text)
        last: list[str] = [""] * (n + 1)
        pair, fits, done = self.pair, self.fits, 0
        if len(pair) >= CACHE:
            pair.clear()
        for at, p in self.automaton.iter(text):
            i = at + 1
            while done < at:
                done += 1
                if not last[done]:
                    last[done] = text[done - 1]
            if last[i]:
                continue
            j = i - len(p)
            if j:
                q = last[j]
                ok = pair.get((q, p))
                if ok is None:
                    ok = pair[q, p] = fits(q, p)
                if not ok:
                    continue
            last[i] = p
        for i in range(done + 1, n + 1):
            if not last[i]:
                last[i] = text[i - 1]
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.split(text):
            k = self.id_of.get(p)
            if k is not None:
                out.append(k)
            elif self.of_byte:
                out += [self.of_byte[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk)
        return out

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.pattern.findall(marked) if self.cuts else [marked]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.cut(text) for i in self.ids(c)]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, as the library gives it."""
        out: list[str] = []
        run = bytearray()
        at_start = True

        def flush() -> None:
            nonlocal at_start
            if run:
                out.append(_utf8(bytes(run)))
                at_start = False
                run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            flush()
            if i in self.control:
                continue
            if i == self.unk:
                out.append(" ⁇ ")
                at_start = False
                continue
            p = self.piece[i]
            if at_start and p[:1] == SPACE:
                p = p[1:]
            at_start = False
            out.append(p.replace(SPACE, " "))
        flush()
        return "".join(out)

    def forget(self) -> None:
        """Empties the cache of cuts: workers live on after their task, beside those of other steps."""
        for held in (self.text_ids, self.text_back, self.old_ids, self.old_back):
            held.clear()
        self.text_bytes = 0

    def both(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by commas, and the text that they decode to."""
        ids, back = self.text_ids, self.text_back
        cuts = self.cut(text)
        if not self.cuts:
            got = self.encode(text)
            return ",".join(map(str, got)), self.decode(got)
        if self.text_bytes >= CACHE_BYTES // 2:  # what was looked up since the last time stays for one more
            self.old_ids, self.old_back = dict(ids), dict(back)
            ids.clear()
            back.clear()
            self.text_bytes = 0
        old = self.old_ids
        for c in {c for c in cuts if c not in ids}:
            if c in old:
                ids[c], back[c] = old[c], self.old_back[c]
                self.text_bytes += 4 * len(c) + len(ids[c]) + 300
                continue
            got = self.ids(c)
            ids[c] = ",".join(map(str, got))
            self.text_bytes += 4 * len(c) + len(ids[c]) + 300  # strings of four bytes a character at most, and what dictionaries need
            back[c] = "".join([self.surface[i] for i in got]) if not self.byte_of.keys() & got else self.decode([self.id_of[SPACE], *got])
        # Each cut begins with a space mark, of which the first in the text is the model's own.
        return ",".join(map(ids.__getitem__, cuts)), "".join(map(back.__getitem__, cuts))[1:]


def _utf8(raw: bytes) -> str:
    """Characters of the bytes, U+FFFD for each byte that isn't part of one."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for k in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + k].decode())
                    i += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_tables: dict[str, PrefixTable] = {}


def table_of(model: str) -> PrefixTable:
    """The worker's table of a model; built once."""
    if model not in _tables:
        _tables[model] = PrefixTable(model)
    return _tables[model]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded.

    No begin or end ids. Columns other than the id and the text are ignored. Each
    row is on its own, so nothing is shuffled.
    """
    id_type = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model)
        for part in pieces(batches, 1):
            rows: list[tuple] = []
            for text in part.column(1).to_pylist():
                joined, back = table.both(text or "")
                row = (joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                rows.append((*row, [int(x) for x in joined.split(",")] if joined else [], back) if with_ids else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4])
        table.forget()
        tidy()

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)
