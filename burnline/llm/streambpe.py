"""Operator 11: BPE as a streaming transducer with bounded lookahead.

Encoding reads a text block by block and writes ids as soon as nothing that may
follow can change them. How many symbols that takes is a number of the merge
list alone (`Merges.lookahead`): where two continuations of a text part, a merge
of rank r can happen in one and not in the other, and takes the token left of
the border out of what both agree on; the next merge to do so has a later rank,
and its right part begins with the token that was lost. The longest such chain
of merges bounds what a continuation can undo. A pre-token is therefore held
only as far as that, whatever its length, and so is a run without white space;
runs between spaces are normalised and pre-tokenised by themselves, and short
ones are remembered. Decoding turns ids into bytes and feeds them to an
incremental UTF-8 decoder that keeps the bytes of an unfinished character.

Held whole are what Spark hands over (a row) and, in a run without spaces, the
characters up to the next place where normal forms can be cut: combining marks
without end, or quotes without end, are held until they end.

Nulls: a null text is empty and has no ids. A null doc_id stays. Repeated rows
are encoded each. An empty table gives no rows. Other columns are ignored. Added
tokens in a text become their ids, as the library does by default."""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnline.llm.wordbpe import LETTER_OF_BYTE, Runs, little

#: Characters of a text read at a time, and of the longest run that is normalised in one go.
BLOCK, RUN = 1 << 16, 1 << 10
END = "</w>"


class Merges:
    """A merge list: ranks of pairs of ids, the ids that they make, and the lookahead that the list needs.

    Each token but the alphabet must come from one merge, whose parts come from earlier ones."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab, self.merges = vocab, [tuple(m) for m in merges]
        made: dict[str, int] = {}
        self.ranks: dict[tuple[int, int], int] = {}
        self.wholes = [vocab[a + b] for a, b in self.merges]
        for rank, (a, b) in enumerate(self.merges):
            later = any(len(x.removesuffix(END)) > 1 and x not in made for x in (a, b))
            if a + b in made or a.endswith(END) or later:
                raise ValueError(f"merge {rank} ({a} {b}) has a token of two merges, or a part that isn't made before")
            made[a + b] = rank
            self.ranks[vocab[a], vocab[b]] = rank
        self.made = made

    @cached_property
    def lookahead(self) -> int:
        """Symbols after a token's end that settle it: the longest chain of merges, each weighing its left part."""
        longest: dict[str, int] = {}  # of chains whose last merge has this left part
        most = 0
        for a, b in self.merges:
            chain, spine = 0, b
            while True:  # what the place right of the border may have held before it became b
                chain = max(chain, longest.get(spine, 0))
                if spine not in self.made:
                    break
                spine = self.merges[self.made[spine]][0]
            chain += len(a)
            longest[a] = max(longest.get(a, 0), chain)
            most = max(most, chain)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """The tokens of symbols: the pair of the lowest rank first, from left to right."""
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, none, ids = self.ranks.get, len(self.merges), list(ids)
        ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = (self.wholes[best],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs and links between neighbours."""
        ranks, ids, n = self.ranks, list(ids), len(ids)
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or ranks.get((ids[i], ids[j])) != rank:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j], right[i] = self.wholes[rank], -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (p := ranks.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (p, a))
        return [i for i in ids if i >= 0]


class Piece:
    """One pre-token as a stream of symbols: `feed` gives the ids that are settled, `close` the rest."""

    def __init__(self, tables: "Transducer", window: int = 0):
        self.t, self.open = tables, []
        self.window = window or max(2048, 4 * tables.merges.lookahead)

    def feed(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for a in range(0, len(symbols), self.window):
            self.open += symbols[a : a + self.window]
            if len(self.open) < self.window:
                continue
            settled, at = len(self.open) - self.t.merges.lookahead, 0
            for token in self.t.merges.merge(self.open):
                if at + self.t.length[token] > settled:
                    break
                at += self.t.length[token]
                out.append(token)
            self.open = self.open[at:]
        return out

    def close(self) -> list[int]:
        """The last symbol is a word's last one."""
        ids, self.open = self.open, []
        return self.t.merges.merge([*ids[:-1], self.t.last[ids[-1]]]) if ids else []


class Run:
    """A long run without spaces: normalised and pre-tokenised in cuts, its pre-tokens fed on."""

    def __init__(self, tables: "Transducer"):
        self.t, self.held, self.piece, self.kind = tables, "", Piece(tables), None

    def feed(self, text: str) -> list[int]:
        out, self.held = [], self.held + text
        while m := self.t.marks.search(self.held):  # an added token ends what is before it
            head, self.held = self.held[: m.start()], self.held[m.end() :]
            out += [*self._cut(head), *self._closed(), self.t.vocab_of_mark[m[0]]]
        keep = len(self.held) - self.t.longest_mark
        for i in range(keep, 3, -1):  # normal forms and contractions don't reach over such a place
            if cuts_here(self.held[i]) and "'" not in self.held[i - 3 : i]:
                head, self.held = self.held[:i], self.held[i:]
                return out + self._cut(head)
        return out

    def close(self) -> list[int]:
        head, self.held = self.held, ""
        return [*self._cut(head), *self._closed()]

    def _closed(self) -> list[int]:
        self.kind = None
        return self.piece.close()

    def _cut(self, text: str) -> list[int]:
        if not text:
            return []
        text, out = self.t.norm.normalize_str(text), []
        # A letter (or a sign) before the cut stands for the pre-token that is open, so that it goes on as it began.
        lead = {"letter": "a", "sign": "!"}.get(self.kind, "")
        pieces = [p for p, _ in self.t.pre.pre_tokenize_str(lead + text)]
        if lead:
            pieces[0] = pieces[0][1:]
        for k, p in enumerate(pieces):
            if k or not lead:
                out += self._closed()
            out += self.piece.feed([self.t.vocab[c] for c in p])
        self.kind = self.t.kind(text[-1])
        if self.kind not in ("letter", "sign"):
            out += self._closed()
        return out


@lru_cache(maxsize=1 << 16)
def cuts_here(c: str) -> bool:
    """Whether normal forms never join this character to those before it: no mark, no jamo, none that is unassigned."""
    return c.isascii() or (category(c)[0] in "LNPSZ" and not ("ᄀ" <= c <= "ᇿ" or "ꥠ" <= c <= "꥿" or "ힰ" <= c <= "퟿"))


class Transducer(Runs):
    """Texts to ids, with ids of short runs remembered. One for each worker process and vocabulary."""

    def __init__(self, path: str, limit: int = 500_000):
        super().__init__(path, limit)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab = model["vocab"]
        self.merges = Merges(self.vocab, model["merges"])
        self.last = {self.vocab[c]: self.vocab[c + END] for c in LETTER_OF_BYTE.values()}
        self.length = {i: len(t.removesuffix(END)) for t, i in self.vocab.items()}
        self.vocab_of_mark = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.longest_mark = max(map(len, self.added), default=0) + 2
        self.names = [b""] * self.tok.get_vocab_size(with_added_tokens=True)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.names[i] = token.encode()

    def kind(self, c: str) -> str:
        """letter, sign (neither letter, digit nor space), or other, as the vocabulary's pattern sees it; asked once for each long run's cut."""
        after = [p for p, _ in self.pre.pre_tokenize_str("a" + c)]
        if len(after) == 1:
            return "letter" if after[0] != "a" else "other"
        return "sign" if len(self.pre.pre_tokenize_str("!" + c)) == 1 else "other"

    def pack(self, piece: str) -> bytes:
        """Ids of one pre-token in the byte-level alphabet."""
        p = Piece(self) if len(piece) > RUN else None
        symbols = [self.vocab[c] for c in piece]
        if p:
            return little([*p.feed(symbols), *p.close()])
        symbols[-1] = self.last[symbols[-1]]
        return little(self.merges.merge(symbols))

    def marked(self, run: str) -> bytes:
        return self.long(run)

    def long(self, text: str) -> bytes:
        run = Run(self)
        return little([i for a in range(0, len(text), RUN) for i in run.feed(text[a : a + RUN])] + run.close())

    def fresh(self, run: str) -> bytes:
        return self.long(run) if len(run) > RUN else super().fresh(run)

    def stream(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Ids, as little-endian 32-bit integers, of a text that comes in blocks; what is settled is handed on after each block."""
        held, run = "", None
        for block in blocks:
            text = (held + block).replace("\n", " ")
            held = ""
            if run:  # a run that began in an earlier block
                at = text.find(" ")
                yield little(run.feed(text if at < 0 else text[:at]) + ([] if at < 0 else run.close()))
                if at < 0:
                    continue
                text, run = text[at:], None
            at = text.rfind(" ") + 1
            yield b"".join(map(self.__getitem__, text[:at].split(" ")))
            held = text[at:]
            if len(held) > RUN:
                run, tail, held = Run(self), held, ""
                yield little(run.feed(tail))
        yield little(run.close()) if run else self[held]

    def encode(self, text: str) -> bytes:
        return b"".join(self.stream(text[a : a + BLOCK] for a in range(0, len(text), BLOCK))) if len(text) > BLOCK else super().encode(text)


class Decoder:
    """Ids to text, block by block. `names` are the bytes of each token, `between` stands between two of them.

    The state is the bytes of a character that hasn't ended yet (three at most) and whether a token came before."""

    def __init__(self, names: list[bytes], between: bytes = b""):
        self.names, self.between, self.begun = names, between, False
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = self.between.join(map(self.names.__getitem__, ids))
        if self.begun:
            raw = self.between + raw
        self.begun = True
        return self.text.decode(raw)

    def close(self) -> str:
        return self.text.decode(b"", True)


def plain_names(names: list[bytes]) -> list[bytes]:
    """The bytes that tokens stand for: the byte-level alphabet undone, a space at a word's end."""
    byte = {c: b for b, c in LETTER_OF_BYTE.items()}
    out = []
    for name in names:
        t = name.decode()
        stem = t.removesuffix(END)
        out.append(name if any(c not in byte for c in stem) or t.startswith("<|") else bytes(byte[c] for c in stem) + b" " * (t != stem))
    return out


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.encode(x.as_py() or "") for x in b.column(1)], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode(rows: DataFrame, tokenizer: str, plain: bool = False) -> DataFrame:
    """(doc_id, ids) with `decoded`: as the library renders ids without a decoder (tokens and spaces between), or (plain) the words they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = transducer(tokenizer).names
        names, between = (plain_names(names), b"") if plain else (names, b" ")
        for b in batches:
            out = []
            for raw in b.column(1):
                ids, d = np.frombuffer(raw.as_py() or b"", "<u4"), Decoder(names, between)
                out.append("".join([*(d.feed(ids[a : a + BLOCK].tolist()) for a in range(0, len(ids), BLOCK)), d.close()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, which are hashed block by block as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        t = transducer(tokenizer)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1):
                text, d, count, of_ids, of_text = x.as_py() or "", Decoder(t.names, b" "), 0, sha256(), sha256()
                for ids in t.stream(text[a : a + BLOCK] for a in range(0, len(text), BLOCK)):
                    of_ids.update(ids)
                    of_text.update(d.feed(np.frombuffer(ids, "<u4").tolist()).encode())
                    count += len(ids) // 4
                of_text.update(d.close().encode())
                n.append(count)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
