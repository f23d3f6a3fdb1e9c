"""Quality rules: base counters, and content share by a linear-chain CRF over lines.

Every line of a text gets a vector of binary features.  A linear-chain
conditional random field, trained here on the small labelled table below,
labels the lines as content or boilerplate by Viterbi decoding.  A document
stays when its content lines hold at least ``share`` of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import BLANKS, LANES, U64, grams, mix, slices, text_buffers
from .words import _hash as byte_hash

CONTENT, BOILERPLATE = 0, 1

#: Labelled documents: (label, line) with c for content and b for boilerplate.
LABELLED: list[list[tuple[str, str]]] = [
    [("c", "The committee met on Tuesday to discuss the plan for the harbour, and most of the members agreed that it was late."), ("c", "It will meet again in spring."), ("b", "All rights reserved.")],
    [("b", "Home | News | Sport | Weather | Contact"), ("c", "A storm is expected to reach the coast tonight, with heavy rain in the hills and strong wind near the sea."), ("c", "People are told to stay at home. Trains will not run before noon."), ("b", "Share | Print | Send")],
    [("b", "BUY NOW!! BEST PRICE!! ONLY TODAY!! CLICK HERE!! BUY NOW!! BEST PRICE!! ONLY TODAY!! CLICK HERE!!"), ("b", "FREE!! FREE!! CALL NOW!!")],
    [("b", "cheap cheap cheap cheap cheap cheap cheap cheap watch watch watch watch watch watch watch watch"), ("b", "cheap cheap cheap cheap watch watch watch watch watch")],
    [("b", "This*** is### not%%% really$$$ text&&& at*** all### but%%% a$$$ row&&& of*** marks."), ("b", "More### marks%%% follow$$$ here&&& and*** there###")],
    [("c", "She opened the old letter slowly, for she had waited for it since the summer, and read it twice by the window."), ("c", "Nothing in it was new."), ("c", "Outside the rain had stopped and the first carts were moving again over the bridge towards the market."), ("c", "Then she burned it.")],
    [("c", "Die Sitzung dauerte lange, und am Ende waren sich fast alle darin einig, dass der Plan noch einmal geprüft werden muss."), ("b", "Impressum | Datenschutz | Kontakt"), ("c", "Im Frühling wird weiter beraten.")],
    [("c", "Le conseil se réunit au printemps pour parler du port, et la plupart des membres pensent que le projet est en retard."), ("c", "Il faudra attendre.")],
    [("c", "El puerto se cierra hoy por la lluvia y el viento, y nadie sabe cuándo se podrá volver a salir al mar con los barcos."), ("c", "Habrá que esperar."), ("b", "Todos los derechos reservados.")],
    [("b", "name | price | stock | size |"), ("b", "lamp | 30 | 4 | small |"), ("b", "chair | 80 | 2 | large |"), ("b", "table | 200 | 1 | large |"), ("c", "Prices are shown with tax and without delivery.")],
    [("b", "Every### word*** of%%% this$$$ long&&& line### has*** marks%%% behind$$$ it,&&& so### that*** no%%% one$$$ can&&& read### it*** as%%% text$$$ at&&& all.###"), ("b", "And### the*** next%%% one$$$ is&&& the### same,*** with%%% marks$$$ after&&& each### of*** its%%% words$$$ too.&&&"), ("b", "So### is*** this.%%%")],
    [("b", "red | green | blue | white | black | brown | grey | pink | gold | silver | bronze | copper | iron | tin | lead | zinc | steel"), ("b", "one | two | three. | four | five | six, | seven | eight | nine. | ten | Eleven | twelve | thirteen | fourteen | fifteen.")],
    [("b", "THE OFFER IS ONLY GOOD FOR TODAY AND ONLY WHILE STOCKS LAST SO ORDER NOW AND SAVE ON ALL OF OUR LAMPS AND CHAIRS!!")],
    [("b", "login login login login"), ("b", "####### ******* $$$$$$$ %%%%%%%"), ("b", "!!! !!! !!! !!!")],
    [("c", "Call us on 555 0100 or write to the office if you need the forms before the end of the month, since they are sent by post."), ("c", "The office is open from nine to five."), ("b", "Licensed under the terms of the notice above.")],
    [("c", "NASA and ESA said on Monday that the launch of the probe was put off by a week because of the weather at the site."), ("c", "A new date was not given. The crew stays on the ground.")],
    [("b", "WIN BIG!! PLAY NOW!! WIN BIG!! PLAY NOW!! WIN BIG!! PLAY NOW!!"), ("b", "WIN BIG!! PLAY NOW!!"), ("b", "WIN BIG!! PLAY NOW!!")],
    [("b", "menu menu menu menu menu items items items items items"), ("c", "The soup of the day is made from what the garden gives, and it is served with bread and a glass of cold water.")],
    [("c", "We thank all who came. We thank all who sent help, and above all those who stayed until the last chair was put away.")],
]

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b'.?!:;"')] = True

N_FEATURES = 14


class Lines:
    """Counters and line features of the rows of one slice."""

    def __init__(self, piece: np.ndarray, local: np.ndarray, counts: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        docs = len(counts)
        rows = np.repeat(np.arange(docs), counts)
        # lines: each row begins one, and so does each place after a line feed
        breaks = np.flatnonzero(piece == 10) + 1
        cuts = np.sort(np.concatenate([local[:-1], breaks]), kind="stable")
        owner = np.searchsorted(local, cuts, "right") - 1
        owner = np.minimum(owner, docs - 1)
        # a break at a row's very end opens an empty last line of that row, not of the next
        if len(breaks):
            both = np.concatenate([np.arange(docs), np.searchsorted(local, breaks - 1, "right") - 1])
            spots = np.concatenate([local[:-1], breaks])
            o = np.lexsort((spots, both))
            cuts, owner = spots[o], both[o]
        stops = np.r_[cuts[1:], len(piece)]
        last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.zeros(0, bool)
        stops[last] = local[owner[last] + 1]
        self.owner, self.docs = owner, docs

        def held(mask: np.ndarray, a: np.ndarray = cuts, b: np.ndarray = stops) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return total[b] - total[a]

        points = (piece & 0xC0) != 0x80
        inside = points & ~BLANKS[piece]
        symbols = _SYMBOLS[piece]
        self.word_chars = held(inside, local[:-1], local[1:])
        self.symbols = held(symbols, local[:-1], local[1:])
        self.words = counts
        # words by line
        a, b = np.searchsorted(starts, cuts), np.searchsorted(starts, stops)
        n = b - a
        # words in 3-word windows that the text holds twice or more
        windows, at = grams(hashes, counts, 3)
        with np.errstate(over="ignore"):
            keys = mix(windows + rows[at].astype(np.uint64) * LANES[30]) if len(at) else windows
        o = np.argsort(keys, kind="stable")
        keys = keys[o]
        same = np.r_[False, keys[1:] == keys[:-1]] if len(keys) else np.zeros(0, bool)
        again = same | np.r_[same[1:], False] if len(keys) else same
        cover = np.zeros(len(hashes) + 4, np.int64)
        np.add.at(cover, at[o[again]], 1)
        np.add.at(cover, at[o[again]] + 3, -1)
        repeated = np.cumsum(cover)[: len(hashes)] > 0
        total = np.concatenate([[0], np.cumsum(repeated, dtype=np.int64)])
        ends_of = np.cumsum(counts)
        self.repeated = total[ends_of] - total[ends_of - counts]
        line_repeated = total[b] - total[a]
        twice = np.r_[False, (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])] if len(hashes) else np.zeros(0, bool)
        total = np.concatenate([[0], np.cumsum(twice, dtype=np.int64)])
        adjacent = total[b] - total[a]
        # lines equal to an earlier line of their text
        trimmed = np.where(last, stops, stops - 1)
        if len(piece):
            with np.errstate(over="ignore"):
                digest = mix(byte_hash(piece, cuts.clip(0, len(piece) - 1), trimmed) + owner.astype(np.uint64) * LANES[31] + (trimmed - cuts).astype(np.uint64) * LANES[32])
        else:
            digest = owner.astype(np.uint64)
        o = np.argsort(digest, kind="stable")
        same = np.zeros(len(o), bool)
        same[o[1:]] = digest[o[1:]] == digest[o[:-1]]
        dup = same & (n > 0)
        self.dup_lines = np.bincount(owner[dup], minlength=docs)
        self.line_words = n
        chars = np.maximum(held(inside), 1)
        letters = held(_LETTER[piece] & points)
        bangs = held(piece == ord("!"))
        pipes = held(piece == ord("|"))
        tail = np.zeros(len(cuts), bool)
        some = n > 0
        tail[some] = _STOP[piece[ends[b[some] - 1] - 1]]
        w = np.maximum(n, 1)
        x = np.zeros((len(cuts), N_FEATURES))
        x[:, 0] = 1
        x[:, 1] = n == 0
        x[:, 2] = (n > 0) & (n < 5)
        x[:, 3] = n >= 12
        x[:, 4] = held(symbols) > 0.5 * w
        x[:, 5] = (held(_UPPER[piece]) > 0.6 * np.maximum(letters, 1)) & (letters > 3)
        x[:, 6] = pipes * 6 >= w
        x[:, 6] *= pipes > 0
        x[:, 7] = (line_repeated > 0.5 * w) & (n >= 3)
        x[:, 8] = adjacent > 0.3 * w
        x[:, 9] = dup
        x[:, 10] = (bangs > 0.3 * w) & (bangs > 0)
        x[:, 11] = ~tail & (n > 0) & (n < 12)
        x[:, 12] = (letters < 0.75 * chars) & (n > 0)
        x[:, 13] = held(symbols) > 1.5 * w
        self.features = x


def line_slices(texts: pa.Array) -> Iterator[tuple[int, Lines]]:
    """First row and lines of each slice of rows."""
    data, cuts = text_buffers(texts)
    for w in slices(data, cuts, BLANKS, lower=False):
        local = cuts[w.lo : w.hi + 1] - cuts[w.lo]
        yield w.lo, Lines(data[cuts[w.lo] : cuts[w.hi]], local, w.counts, w.hashes, w.starts, w.ends)


class LineCrf:
    """Two labels; ``emit`` (labels x features) and ``move`` (from, to) weights."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    @staticmethod
    def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis)
        return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))

    @classmethod
    def trained(cls, table: list[list[tuple[str, str]]], *, rounds: int = 300, rate: float = 0.8, decay: float = 0.02) -> LineCrf:
        """Maximum regularised likelihood by gradient ascent with forward-backward sums."""
        data = []
        for doc in table:
            _, lines = next(line_slices(pa.array(["\n".join(line for _, line in doc)])))
            data.append((lines.features, np.array([CONTENT if label == "c" else BOILERPLATE for label, _ in doc])))
        emit, move = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
        for _ in range(rounds):
            up_emit, up_move = -decay * emit, -decay * move
            for x, y in data:
                score = x @ emit.T
                n = len(y)
                ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
                ahead[0] = score[0]
                for i in range(1, n):
                    ahead[i] = score[i] + cls._log_sum(ahead[i - 1][:, None] + move, 0)
                for i in range(n - 2, -1, -1):
                    back[i] = cls._log_sum(move + score[i + 1] + back[i + 1], 1)
                whole = cls._log_sum(ahead[-1], 0)
                seen = np.eye(2)[y]
                up_emit += (seen - np.exp(ahead + back - whole)).T @ x
                for i in range(1, n):
                    up_move -= np.exp(ahead[i - 1][:, None] + move + score[i] + back[i] - whole)
                    up_move[y[i - 1], y[i]] += 1
            emit, move = emit + rate * up_emit / len(data), move + rate * up_move / len(data)
        return cls(emit, move)

    def viterbi(self, scores: list[list[float]]) -> list[int]:
        """The likeliest labels of one document's lines, from their emission scores."""
        (cc, cb), (bc, bb) = self.move.tolist()
        c, b = scores[0]
        steps = []
        for x, y in scores[1:]:
            from_c, from_b = c + cc >= b + bc, c + cb > b + bb
            steps.append((from_c, from_b))
            c, b = (c + cc if from_c else b + bc) + x, (c + cb if from_b else b + bb) + y
        at = CONTENT if c >= b else BOILERPLATE
        out = [at]
        for from_c, from_b in reversed(steps):
            at = CONTENT if (from_c if at == CONTENT else from_b) else BOILERPLATE
            out.append(at)
        return out[::-1]


@lru_cache(maxsize=1)
def line_model() -> LineCrf:
    """The CRF trained on LABELLED; a fixed table, so every process gets the same weights."""
    return LineCrf.trained(LABELLED)


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words"]


def counted(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counters of every row of a batch."""
    crf = line_model()
    out = {k: np.zeros(len(texts), np.int64) for k in _FIELDS}
    for lo, lines in line_slices(texts):
        content = np.zeros(lines.docs, np.int64)
        scores = (lines.features @ crf.emit.T).tolist()
        words = lines.line_words.tolist()
        cuts = np.searchsorted(lines.owner, np.arange(lines.docs + 1)).tolist()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            content[k] = sum(n for n, label in zip(words[a:b], crf.viterbi(scores[a:b]), strict=True) if label == CONTENT)
        for k, x in zip(_FIELDS, (lines.words, lines.word_chars, lines.symbols, lines.dup_lines, lines.repeated, content), strict=True):
            out[k][lo : lo + lines.docs] = x
    return out


def _verdict(c: dict[str, np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray]:
    failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    return failed, ~failed & (c["content_words"] >= share * c["n_words"])


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5) -> DataFrame:
    """Counters and verdict of each row.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has zero counts
    and fails; null ids and repeated rows keep a row each.  Other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(k, T.LongType()) for k in _FIELDS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = counted(batch.column(1))
            failed, kept = _verdict(c, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[k]) for k in _FIELDS), pa.array(failed), pa.array(kept)], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_quality(docs: DataFrame, *, text_col: str = "text", share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_verdict(counted(batch.column(at)), share)[1]))

    return docs.mapInArrow(run, docs.schema)
