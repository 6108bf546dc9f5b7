"""Op 10: quality rules from tokeniser fertility.

Method: a public vocabulary with byte fallback splits every word; per text it gives characters per
token, the share of byte-fallback tokens and the token entropy. Each language (or else the script
that most letters belong to) has a band for each of the three; a text outside a band is rejected.
The bands are parameters: they are the same for any number of documents, and no statistic of the
corpus decides on a text. Plain counts of words, symbols, repeated lines and repeated windows come
from the same pass.

Results for odd inputs: null and empty texts have no words and fail the base rule; a text of any
length is measured whole; ties and repeated rows are measured alike; a null or unknown language
uses the band of its script; further columns are passed through by ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import IS_SPACE, U64, Words, chunks, gram_hashes, held, mix, ragged, repeats, span_hashes, sums_by_row
from .tables import unused

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Words whose tokens a worker keeps before it starts anew.
CACHE_WORDS = 200_000
WINDOW = 8


@dataclass(frozen=True)
class Band:
    """Accepted ranges. ``curve`` (c0, c1, c2) gives the usual token entropy of a text of n tokens,
    c0 + c1 * L + c2 * L * L with L = log2(n) (``SATURATED`` at most); a text may lie ``slack`` bits below."""

    chars_per_token: tuple[float, float]
    byte_share: float
    curve: tuple[float, float, float]
    slack: float


#: Bands by language, then by script; ``*`` holds for whatever is in neither. The entropy curves are
#: those of prose with function words; running symbols, separators or repeats between words lower it.
BANDS = {
    "en": Band((1.5, 9.0), 0.05, (0.97, 0.985, -0.0400), 0.40),
    "de": Band((1.5, 9.0), 0.05, (1.73, 0.826, -0.0340), 0.40),
    "fr": Band((1.4, 9.0), 0.05, (2.00, 0.768, -0.0315), 0.40),
    "es": Band((1.4, 9.0), 0.05, (1.62, 0.846, -0.0345), 0.42),
    "latin": Band((1.2, 9.0), 0.10, (1.62, 0.846, -0.0345), 0.70),
    "greek": Band((0.6, 6.0), 0.40, (1.62, 0.846, -0.0345), 1.20),
    "cyrillic": Band((1.0, 7.0), 0.20, (1.62, 0.846, -0.0345), 0.90),
    "hebrew": Band((0.5, 6.0), 0.50, (1.62, 0.846, -0.0345), 1.40),
    "arabic": Band((0.5, 6.0), 0.50, (1.62, 0.846, -0.0345), 1.40),
    "indic": Band((0.3, 5.0), 0.95, (1.62, 0.846, -0.0345), 1.80),
    "han": Band((0.3, 3.0), 0.90, (1.62, 0.846, -0.0345), 1.40),
    "kana": Band((0.3, 3.0), 0.90, (1.62, 0.846, -0.0345), 1.40),
    "hangul": Band((0.3, 3.0), 0.95, (1.62, 0.846, -0.0345), 1.60),
    "*": Band((0.2, 12.0), 1.00, (1.62, 0.846, -0.0345), 2.50),
}
#: Log2 of the token count beyond which the usual entropy doesn't rise.
SATURATED = 11.5

def script_of(text_col: str | Column) -> Column:
    """The script with the most letters, first in the list on ties."""
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    ranges = {"latin": r"a-zA-ZÀ-ɏḀ-ỿ", "greek": r"Ͱ-Ͽἀ-῿", "cyrillic": r"Ѐ-ԯ", "hebrew": r"֐-׿", "arabic": r"؀-ࣿ", "indic": r"ऀ-෿", "kana": r"぀-ヿ", "han": r"㐀-鿿豈-﫿", "hangul": r"가-힯"}
    counts = [F.struct(F.length(F.regexp_replace(text, f"[^{r}]+", "")).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("s")) for i, (name, r) in enumerate(ranges.items())]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["s"]).otherwise(F.lit("*"))


class Pieces:
    """Cached tokens of words, by a vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.begins = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def tokens(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.index) > CACHE_WORDS:
            self._clear()
        get = self.index.get
        found = [get(h, -1) for h in distinct.tolist()]
        new = [i for i, f in enumerate(found) if f < 0]
        if new:
            raw = words.data.tobytes()
            where = at[new]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist(), strict=True)]
            got = self.model.encode(texts, num_threads=1)
            sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            base, n = len(self.flat), len(self.index)
            self.flat = np.concatenate([self.flat, np.fromiter((x for ids in got for x in ids), dtype=np.int32, count=int(sizes.sum()))])
            self.begins = np.concatenate([self.begins, base + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            for k, i in enumerate(new):
                found[i] = n + k
            self.index.update(zip(distinct[new].tolist(), range(n, n + len(new)), strict=True))
        entry = np.array(found, dtype=np.int64)[which] if len(found) else np.zeros(0, dtype=np.int64)
        lengths = self.lengths[entry]
        return self.flat[ragged(self.begins[entry], lengths)], lengths


def pieces(path: str) -> Pieces:
    """One for each worker and file."""
    own = held("fertility")
    if path not in own:
        own[path] = Pieces(path)
    return own[path]


def _measure(data: np.ndarray, offsets: np.ndarray, model: Pieces) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    words = Words(data, offsets)
    n_words = np.diff(words.first)
    solid = ~IS_SPACE[data]
    word_chars = sums_by_row(solid & ((data & 0xC0) != 0x80), offsets)
    n_symbols = sums_by_row(SYMBOLS[data], offsets)

    # lines with a word, equal to an earlier one
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, starts)])
    row = np.searchsorted(offsets, starts, side="right") - 1
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[has], ends[has], row[has]
    keys = span_hashes(words.sums, starts, ends) ^ mix(row.astype(U64))
    n_dup = np.bincount(row, minlength=rows) - np.bincount(row[np.unique(keys, return_index=True)[1]], minlength=rows)

    # words in windows that occur twice or more
    hashes = words.hashes()
    grams = gram_hashes(hashes, WINDOW)
    whole = words.row[: len(grams)] == words.row[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    again = at[repeats(grams[at] ^ mix(words.row[at].astype(U64) + U64(1 << 40)))]
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    n_repeat = np.bincount(words.row[covered], minlength=rows)

    ids, lengths = model.tokens(words, hashes)
    owner = np.repeat(words.row, lengths)
    n_tokens = np.bincount(owner, minlength=rows)
    n_bytes = np.bincount(owner[model.is_byte[ids]], minlength=rows)
    key, count = np.unique(owner * model.size + ids, return_counts=True)
    doc = key // model.size
    share = count / np.maximum(n_tokens[doc], 1)
    entropy = np.bincount(doc, weights=-share * np.log2(share), minlength=rows).astype(float)  # counts without any item are whole numbers
    some = np.maximum(n_tokens, 1)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "n_tokens": n_tokens,
        "chars_per_token": word_chars / some,
        "byte_share": n_bytes / some,
        "entropy": entropy,
    }


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"


def measure(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then a struct of MEASURES (measures, with underscores behind where that name is taken)."""
    name = unused("measures", docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for first, end, data, at in chunks(batch.column(where)):
                found = _measure(data, at, model)
                struct = pa.StructArray.from_arrays([pa.array(v) for v in found.values()], list(found))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], [*part.schema.names, name])

    return docs.mapInArrow(run, f"{schema}, {name} struct<{MEASURES.replace(' long', ':bigint').replace(' double', ':double')}>")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def fits(m: Column, lang: Column, script: Column, bands: dict[str, Band] = BANDS) -> Column:
    """True where all three measures are inside the band of the language, else of the script."""

    def limits(band: Band) -> Column:
        return F.array(*[F.lit(float(x)) for x in (*band.chars_per_token, band.byte_share, *band.curve, band.slack)])

    table = F.create_map(*[x for name, band in bands.items() for x in (F.lit(name), limits(band))])
    known = [k for k in bands if k != "*"]
    group = F.coalesce(F.when(lang.isin(known), lang), F.when(script.isin(known), script), F.lit("*"))
    low, high, share, c0, c1, c2, slack = (F.element_at(table, group)[i] for i in range(7))
    length = F.least(F.log2(F.greatest(m["n_tokens"], F.lit(1))), F.lit(SATURATED))
    least = c0 + c1 * length + c2 * length * length - slack
    return m["chars_per_token"].between(low, high) & (m["byte_share"] <= share) & (m["entropy"] >= least)


def judge(docs: DataFrame, path: str, text_col: str = "text", lang_col: str | None = "lang", bands: dict[str, Band] = BANDS) -> DataFrame:
    """All columns of ``docs``, then measures, base_failed and kept (with underscores behind where such a name is taken)."""
    lang = F.lower(F.col(lang_col)) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    known = lang.isin([k for k in bands if k != "*"])
    script = F.when(F.coalesce(known, F.lit(False)), F.lit(None).cast("string")).otherwise(script_of(text_col))
    out = measure(docs, path, text_col)
    m = F.col(out.columns[-1])
    failed, kept = (unused(n, docs.columns) for n in ("base_failed", "kept"))
    return out.withColumns({failed: base_failed(m), kept: ~base_failed(m) & fits(m, lang, script, bands)})


def filter_documents(docs: DataFrame, path: str, text_col: str = "text", lang_col: str | None = "lang", bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were."""
    judged = judge(docs, path, text_col, lang_col, bands)
    return judged.where(F.col(judged.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])
