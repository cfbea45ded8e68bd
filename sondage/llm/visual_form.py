"""Visually identical text with different characters, brought to one form.

The normal form is found by quick-check properties: only characters that are not stable by themselves (they may compose
with what stands before, are no canonical form, or are folded here) open a segment. A segment takes the stable character
before it as context, is decomposed, folded and composed, and is spliced into the text, the rest of which stays as it is.
Folded are full-width and other forms of one letter's glyph, invisible characters and kinds of blank. Words that mix Latin
letters with letters of other scripts that look like them become Latin.

Genuine words of other scripts stay in the text. Whether two texts look the same is told by a key: the digest of the
normal form with every letter that looks like a Latin one folded. Letters, case, accents, digits and raised digits that a
reader can tell apart stay apart in both.

Cases: null stays null, an empty text stays empty; ASCII texts are returned unchanged; a zero-width joiner or variation
selector stays where it shapes an emoji, as that is visible; very long texts are read whole; repeated rows each get
their row. Equal texts are no pair. Rows with a null id, or a null or blank text, are in no pair.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.storage import written

# Letters of other scripts whose glyph is that of a Latin letter, after canonical decomposition.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХУԌԚԜҮӀаеорсухѕіјһԁԛԝӏҽ", "ABESIJKMHOPCTXYGQWYlaeopcyxsijhdqwle"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳοϲρνγ", "ABEZHIKMNOPTYXjocpvy"))
ARMENIAN = dict(zip("ՍՕօսոհց", "UOounhg"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"))
LATIN = dict(zip("ɑɡıɩƖ", "agiil"))
COPTIC = dict(zip("ⲞⲢⲤⲟⲣⲥ", "OPCopc"))
OTHER = dict(zip("Ⅽ Ⅾ Ⅰ Ⅼ Ⅿ Ⅴ Ⅹ ⅽ ⅾ ⅰ ⅼ ⅿ ⅴ ⅹ ‐ ‑ ꞏ".split(), "C D I L M V X c d i l m v x - - ·".split()))
#: Lisu letters are Latin capitals, and are named after them.
LISU = {chr(c): m[1] for c in range(0xA4D0, 0xA4F8) if (m := re.fullmatch(r"LISU LETTER (?:([BCDFGHJKLMNPSTVWXYZ])A|([AEIOU]))", unicodedata.name(chr(c), ""))) and m[1]}
LOOKALIKES = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | LATIN | COPTIC | LISU | OTHER

_EMOJI = "☀-➿⬀-⯿\U0001f000-\U0001faff"
_SHAPING = re.compile(f"(?<=[{_EMOJI}\ufe0f])\u200d(?=[{_EMOJI}])|(?<=[{_EMOJI}0-9#*])[\ufe0e\ufe0f]")
_KEEP = {"\u200d": "\ue000", "\ufe0f": "\ue001", "\ufe0e": "\ue002"}
_BACK = str.maketrans({v: k for k, v in _KEEP.items()})
_INVISIBLE = frozenset("\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0")
_FOLDED_KINDS = frozenset(("Zs", "Zl", "Zp", "Cf"))
_SELECTORS = ((0xFE00, 0xFE0F), (0x180B, 0x180F), (0xE0100, 0xE01EF))
#: Compatibility forms that are the glyph of what they stand for: widths, mathematical alphabets, ligatures of letters.
_SAME_GLYPH = ("<wide>", "<narrow>", "<small>", "<font>")


class _Folds(dict):
    """Character to what stands for it in the normal form, found by rule when first met."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        kind, parts = unicodedata.category(ch), unicodedata.decomposition(ch)
        to: str | None = ch
        if kind == "Zs":
            to = " "
        elif kind in ("Zl", "Zp"):
            to = "\n"
        elif kind == "Cf" or ch in _INVISIBLE or any(a <= code <= z for a, z in _SELECTORS):
            to = None
        elif parts.startswith(_SAME_GLYPH) or parts.startswith("<compat>") and (code == 0xB5 or 0xFB00 <= code <= 0xFB06):
            to = unicodedata.normalize("NFKC", ch)
        self[code] = to
        return to


class _Looks(dict):
    """Character to the same with every letter in it folded that looks like a Latin one."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFD", chr(code))
        self[code] = to = unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in parts))
        return to


_FOLDS, _LOOKS = _Folds(), _Looks()
#: Where characters that are not stable by themselves can be; outside are ideographs, Hangul syllables and private use.
_RANGES = ((0x80, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


@lru_cache(maxsize=1)
def _unstable() -> re.Pattern:
    """Runs of characters without the quick-check property: made by rule from the character database, once a process.

    Not stable is what is folded, has a combining class, is not its own canonical form, or is the second part of one.
    """
    second = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    found = []
    for a, z in _RANGES:
        for code in range(a, z):
            ch = chr(code)
            parts = unicodedata.decomposition(ch)
            if not parts:
                if unicodedata.combining(ch) or unicodedata.category(ch) in _FOLDED_KINDS or ch in _INVISIBLE:
                    found.append(code)
                continue
            if parts[0] != "<":
                pair = parts.split()
                if len(pair) == 2 and unicodedata.is_normalized("NFC", ch):
                    second.add(chr(int(pair[1], 16)))
            if unicodedata.combining(ch) or _FOLDS[code] != ch or not unicodedata.is_normalized("NFC", ch):
                found.append(code)
    found += [code for a, z in _SELECTORS for code in range(a, z + 1)]
    codes = sorted({*found, *map(ord, second)})
    spans: list[list[int]] = []
    for code in codes:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in spans) + "]+")


_MEMO: dict[str, str] = {}


def _settled(segment: str, after: str) -> str:
    """The normal form of a segment; ``after`` is the character that follows it."""
    if (known := _MEMO.get(segment)) is not None:
        return known
    shaped = "\u200d" in segment or "\ufe0f" in segment or "\ufe0e" in segment
    held = _SHAPING.sub(lambda x: _KEEP[x[0]], segment + after)[: len(segment)] if shaped else segment
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", held).translate(_FOLDS)).translate(_BACK)
    if not shaped and len(segment) <= 64:
        if len(_MEMO) > 200_000:
            _MEMO.clear()
        _MEMO[segment] = out
    return out


def normal_form(text: str | None) -> str | None:
    """The text with its unstable segments in their normal form; genuine words of any script stay."""
    if text is None or text.isascii():
        return text
    pieces, at = [], 0
    for m in _unstable().finditer(text):
        start = max(m.start() - 1, at)
        pieces.append(text[at:start])
        pieces.append(_settled(text[start : m.end()], text[m.end() : m.end() + 1]))
        at = m.end()
    return "".join(pieces) + text[at:] if pieces else text


_MIXED = re.compile(r"(?=\w*[A-Za-z])(?=\w*[^\x00-\x7f])\w+")
_OTHERS = re.compile(r"[^\x00-\x7f]+")


def consistent_form(text: str | None) -> str | None:
    """The normal form, with words that mix Latin letters and letters that look like them made Latin."""
    if text is None or text.isascii():
        return text

    def latin(m: re.Match) -> str:
        folded = m[0].translate(_LOOKS)
        return folded if folded.isascii() else m[0]

    return _MIXED.sub(latin, normal_form(text))


def one_form(text: str | None) -> str | None:
    """What a reader sees of a text: its normal form with look-alike letters folded. Equal for texts that look the same."""
    if text is None or text.isascii():
        return text
    plain = normal_form(text)
    if plain.isascii():
        return plain
    folded = _OTHERS.sub(lambda m: m[0].translate(_LOOKS), plain)
    return folded if folded == plain else normal_form(folded)


def consistent_texts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, look): every text in its consistent form, and the key that texts of one look share (null for a null
    text). One narrow pass over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            looks = [None if t is None else _digest(one_form(t)).hex() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([consistent_form(t) for t in texts], pa.string()), pa.array(looks, pa.string())], names=["doc_id", "text", "look"])

    source = documents.select(documents[id_column].cast("bigint").alias("doc_id"), documents[text_column].alias("text"))
    return source.mapInArrow(run, "doc_id bigint, text string, look string")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def form_keys(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, form, raw): 16-byte digests of the consistent form and of the text, for non-blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, forms, raws = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or t is None or not t.strip():
                    continue
                form = one_form(t)
                raws.append(_digest(t))
                forms.append(raws[-1] if form is t or form == t else _digest(form))
                ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], names=["doc_id", "form", "raw"])

    source = documents.select(documents[id_column].cast("bigint").alias("doc_id"), documents[text_column].alias("text"))
    return source.mapInArrow(run, "doc_id bigint, form binary, raw binary")


def same_look_classes(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (raw_a, raw_b) of different texts of one look, and the members (doc_id, raw) of those texts.

    Copies of a text are one class and meet in partial aggregates; only looks with two or more texts go on.
    """
    keys = written(keys, "keys")
    texts = keys.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("copies"))
    several = texts.groupBy("form").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("form")
    classes = written(texts.join(several.hint("merge"), "form", "left_semi").select("form", "raw"), "classes")
    left, right = classes.select("form", F.col("raw").alias("raw_a")), classes.select("form", F.col("raw").alias("raw_b"))
    pairs = left.join(right.hint("merge"), "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    members = keys.join(classes.select("raw").hint("merge"), "raw", "left_semi").select("doc_id", "raw").distinct()
    return pairs, members


def same_look_pairs(keys: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: the pairs of texts as pairs of their documents; the work is that of the result."""
    pairs, members = same_look_classes(keys)
    members = written(members, "members")
    one, other = members.select(F.col("raw").alias("raw_a"), F.col("doc_id").alias("one")), members.select(F.col("raw").alias("raw_b"), F.col("doc_id").alias("other"))
    found = pairs.join(one.hint("merge"), "raw_a").join(other.hint("merge"), "raw_b").where("one != other")
    return found.select(F.least("one", "other").alias("doc_id_a"), F.greatest("one", "other").alias("doc_id_b")).distinct()
