"""The main text of crawled pages, as sentences and their words.

Menus, notices, footers, teasers and titles are lines that aren't made of
sentences; they are told by their form, in any language: a line of main text
ends like a sentence, or holds several complete ones before it is cut. Short lines about cookies are notices whatever their form.
Text that was decoded with a wrong charset is repaired first where the bytes
survived.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

ENDS = re.compile(r"""[.!?]["”»“’')\]]*$""")
#: A cut line, whose mark of omission may have become a question mark.
CUT = re.compile(r"(?:…|\.\.\.|\s[?�])$")
#: The end of a sentence whose closing quotation mark was lost.
LOST_QUOTE = re.compile(r"[.!?]�+$")
#: Complete sentences that make a line main text although its last one is cut.
SEVERAL = 2
NOTICE = re.compile(r"\bcookies?\b", re.I)
#: The most characters and sentences of a notice; more are a paragraph of text.
NOTICE_LENGTH, NOTICE_SENTENCES = 200, 2
SPLIT = re.compile(r"""(?<=[.!?])["”»“’')\]]*\s+(?=["“„«¿¡'(]*\s?[^\W\d_a-zа-яß-ÿ]|["“„«]|\d)""")
#: A lost letter is part of its word.
WORD = re.compile(r"[\w�]{3,}")

_C1 = re.compile("[\x80-\x9f]")
_UTF8_AS_LATIN = re.compile("[Â-ô][\x80-\xbfŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™�]")
_CAPS_INSIDE = re.compile("[а-яё][А-ЯЁ]{2,}")
_HIGH_RUN = re.compile("[À-ÿ]{4,}")
_CYRILLIC_WORD = re.compile("\\b[А-ЯЁа-яё][а-яё]+\\b")


def _single_bytes(text: str) -> bytes:
    """The bytes of a text that was read as windows-1252 or latin-1."""
    out = bytearray()
    for c in text:
        code = ord(c)
        if code < 256:
            out.append(code)
        else:
            out += c.encode("cp1252", "replace")
    return bytes(out)


def repair(text: str) -> str:
    """``text`` with wrong decodings undone: UTF-8 read as windows-1252 or
    latin-1, windows-1252 read as latin-1, KOI8-R read as windows-1251, and
    either of the last two read as latin-1."""
    if len(_UTF8_AS_LATIN.findall(text)) >= 2:
        fixed = _single_bytes(text).decode("utf-8", "replace")
        if fixed.count("�") - text.count("�") <= len(fixed) // 20:
            text = fixed
    if _C1.search(text):
        text = _C1.sub(lambda m: m[0].encode("latin-1").decode("cp1252", "replace"), text)
    if len(_HIGH_RUN.findall(text)) > len(text) // 40:
        raw = _single_bytes(text)
        options = [raw.decode(c, "replace") for c in ("cp1251", "koi8-r")]
        best = max(options, key=lambda t: len(_CYRILLIC_WORD.findall(t)))
        if len(_CYRILLIC_WORD.findall(best)) > len(text) // 40:
            text = best
    if len(_CAPS_INSIDE.findall(text)) > len(text) // 80:
        text = text.encode("cp1251", "replace").decode("koi8-r")
    return text


def _complete(sentence: str) -> bool:
    """Whether a part of a line is a sentence: not a label that ends in a dot or a lost separator."""
    return not CUT.search(sentence) and len(WORD.findall(sentence)) > 2


def sentences(text: str | None) -> list[str]:
    """The sentences of the main text; a null or empty text has none."""
    if not text:
        return []
    found: list[list[str]] = []
    for line in repair(text).split("\n"):
        line = line.strip()
        parts = SPLIT.split(line)
        if len(line) <= NOTICE_LENGTH and len(parts) <= NOTICE_SENTENCES and NOTICE.search(line):
            continue
        if not ENDS.search(line):
            # Of a paragraph that was cut, only the unfinished last sentence is left out.
            if not LOST_QUOTE.search(line):
                parts = parts[:-1]
            if sum(map(_complete, parts)) < SEVERAL:
                continue
        elif len(parts) == 1 and CUT.search(line):
            continue
        found.append(parts)
    # A title is a line above that repeats a sentence of the text.
    if len(found) > 1 and len(found[0]) == 1 and any(s.startswith(found[0][0]) for parts in found[1:] for s in parts):
        found = found[1:]
    return [s for parts in found for s in parts]


def word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, sents, terms, at): the number of sentences,
    and each sentence's different words with its number. Pages without a main
    text have no row."""
    for batch in batches:
        ids, sents, terms, at = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = sentences(text)
            if not found:
                continue
            words, places = [], []
            for k, sentence in enumerate(found):
                own = set(WORD.findall(sentence.lower()))
                words += own
                places += [k] * len(own)
            ids.append(doc_id)
            sents.append(len(found))
            terms.append(words)
            at.append(places)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.schema.field(0).type), pa.array(sents, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "sents", "terms", "at"]
        )
