"""Problem 8: texts read with a wrong character encoding, found and restored.

Method: best-first search over texts. A step undoes one wrong reading: the characters are encoded back with the code page they were
read with and decoded with the one they were written in, or character references are unescaped. States are kept by hash so none is
visited twice; the frontier is a heap ordered by a character-plausibility cost; steps are taken only if they make the text no
dearer, so the search ends, and the cheapest text reached is the result. Double garbling is two steps. Pages that are rarely confused
must save more than their step's price. The cost is of characters, of what words never have, and of letters of a script in shares that
its language doesn't have them in.

Texts are often garbled in parts, so a step works on the spans that are valid sequences under its code page and leaves the others.
"""

from __future__ import annotations

import hashlib
import heapq
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.runtime import ship, spread

# The code pages that UTF-8 is commonly read with. Bytes a page leaves undefined stay the control of that number, so the
# first one also covers texts read as Latin-1.
PAGES = ("cp1252", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "koi8_r")
# Single-byte pages by the script written in them, and the pages that they are read with.
WRITTEN = {"cyrillic": ("cp1251", "koi8_r", "cp866", "iso8859_5"), "greek": ("cp1253", "iso8859_7", "cp737"), "central": ("cp1250", "iso8859_2", "cp852"), "latin": ("cp1252",)}
READ = ("cp1252", "cp1251", "koi8_r", "mac_roman", "cp437", "cp850", "cp866", "cp1250")
# Double-byte pages of Japanese.
DOUBLE = ("cp932", "euc_jp")
# How often each Russian and Greek letter occurs among a thousand.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4, 0.4), strict=True))
GREEK = dict(zip("αοιετσνηυρπκμςλίόωγέδάήχθφύβώζξψϊ", (99, 81, 72, 69, 79, 44, 63, 42, 40, 40, 39, 38, 33, 36, 28, 29, 25, 16, 16, 20, 17, 21, 16, 12, 12, 9, 12, 7, 9, 4, 4, 2, 1), strict=True))
LOST = "�"

# Characters that texts have besides letters and digits of the scripts below.
_MARKS = "’“”‘—–•…′″→←≈≤≥±×÷·⁺⁻℃、。№∞∑∧∨∫√≠∂°µ«»§¶©®™€£¿¡ºª½¼¾²³¹⁰⁴⁵⁶⁷⁸⁹‑ "


def _page(name: str) -> dict[str, int]:
    """Each character beyond ASCII that the page gives, as its byte; bytes it leaves undefined stay the control of that number."""
    table: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if name == "cp1252":
        table |= {chr(b): b for b in range(0x80, 0xA0)}
    return table


def _one_of(table: dict[str, int], low: int, high: int) -> str:
    return "[" + "".join(re.escape(ch) for ch, b in table.items() if low <= b <= high) + "]"


def _spans(table: dict[str, int]) -> re.Pattern:
    """What looks like a sequence of two, three or four UTF-8 bytes."""
    more = _one_of(table, 0x80, 0xBF)
    return re.compile(f"{_one_of(table, 0xC2, 0xDF)}{more}|{_one_of(table, 0xE0, 0xEF)}{more}{{2}}|{_one_of(table, 0xF0, 0xF4)}{more}{{3}}")


_TABLES = {p: _page(p) for p in PAGES}
_SPANS = {p: _spans(t) for p, t in _TABLES.items()}
_ANY_SPAN = re.compile("|".join(f"(?:{r.pattern})" for r in _SPANS.values()))
_IN_A_PAGE = frozenset(ch for t in _TABLES.values() for ch in t if ord(ch) >= 0xA0)
_RUSSIAN = re.compile(r"[А-Яа-яЁё]")
_CONTROL = re.compile(r"[\x80-\x9f]")
_KANA = re.compile(r"[ぁ-ヺー、。]")
_LATIN_RUN = re.compile(r"[À-ÖØ-öø-ÿ]{3,}")
#: Where a text is cut: after a sentence or line. Garbling starts and ends there, and each part may have been read differently.
_CUT = re.compile(r"((?<=[.!?。])[^\S\n]+|\n)")
_REFERENCE = re.compile(r"&(?:#[0-9]{2,6}|#x[0-9A-Fa-f]{2,5}|[A-Za-z]{2,8});")


# Letters of Latin-1 that its larger languages have seldom, and those of Central European languages beyond it.
_SELDOM = frozenset("òìåøæðþýÿÒÌÅØÆÐÞÝÙÛ")
_CENTRAL = frozenset("ĄąĆćĘęŁłŃńŚśŹźŻżČčĎďĚěŇňŘřŠšŤťŮůŽžŐőŰűĹĺĽľŔŕ")


@lru_cache(maxsize=1 << 16)
def char_cost(ch: str) -> float:
    """How implausible a character is by itself: 0 ASCII, 1 usual, up to 3."""
    o = ord(ch)
    if o < 0x80:
        return 0.0
    if o < 0xA0:
        return 2.0
    if ch in _SELDOM:
        return 1.1
    if 0xC0 <= o < 0x100 or 0x391 <= o <= 0x3CE or 0x386 <= o <= 0x390 or 0x410 <= o <= 0x44F or ch in "Ёё" or ch in _MARKS:
        return 1.0
    if 0x3041 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0x2500 <= o <= 0x257F or 0x1F300 <= o <= 0x1FAFF:
        return 1.0
    if ch in _CENTRAL:
        return 1.2
    if 0x400 <= o < 0x530:
        return 3.0  # Cyrillic letters that Russian doesn't have
    if ch in _IN_A_PAGE or o in (0xA0, 0xAD, 0x200B, 0x200D):
        return 1.5
    return 3.0


_HIGH = re.compile(r"[^\x00-\x7f]+")


_MIXED = re.compile(r"(?<=[A-Za-zÀ-ÿ])[Ѐ-ӿ]|(?<=[Ѐ-ӿ])[A-Za-zÀ-ÿ]|(?<=[Ѐ-ӿ])[ぁ-鿿가-힣]|(?<=[ぁ-鿿가-힣])[Ѐ-ӿ]|(?<=[ά-ώ])[Α-Ω]")


def likeness(text: str, shares: dict[str, float], first: str, last: str, more: str) -> tuple[float, int]:
    """How much the letters of a script look like its language (the mean log frequency, less the share of capitals inside words), and
    how many there are."""
    letters = [c for c in text if first <= c <= last or c in more]
    if len(letters) < 6:
        return 9.0, 0
    words, inside, was = 0, 0, False
    for c in text:
        now = first <= c <= last or c in more
        words += now and not was
        inside += now and was and c.isupper()
        was = now
    return sum(log(shares.get(c, 0.1)) for c in "".join(letters).lower()) / len(letters) - inside / max(1, words), len(letters)


#: Russian and Greek score about 3.6; letters of other pages, or accented letters taken for these, mostly below 3. No text scores BEST.
LIKE, BEST = 3.2, 4.0


_LANGUAGES = ((RUSSIAN, "А", "я", "Ёё"), (GREEK, "Ά", "ώ", ""))


def own_language(text: str) -> bool:
    """Whether a text has Cyrillic or Greek letters, and these look like Russian or Greek and share no word with others."""
    found = [likeness(text, *args) for args in _LANGUAGES]
    return any(n and score >= LIKE for score, n in found) and all(score >= LIKE for score, _ in found) and not _MIXED.search(text) and not _ODD.search(text)


def unlike(text: str, like: float) -> float:
    """How far Cyrillic and Greek letters are from a likeness, over all letters."""
    total = 0.0
    for args in _LANGUAGES:
        score, n = likeness(text, *args)
        total += n * max(0.0, like - score)
    return total


def odd(text: str) -> bool:
    """Whether something in a text shows that it may have been read wrongly as a whole."""
    return bool(_ODD.search(text) or _LATIN_RUN.search(text) or _MIXED.search(text) or _CONTROL.search(text)) or unlike(text, LIKE) > 0


def cost(text: str) -> float:
    """The plausibility cost: of the characters; of scripts mixed in a word, runs of accented Latin letters and other things that words
    never have; of character references; of letters in unlikely shares."""
    total = 2.0 * (len(_MIXED.findall(text)) + len(_ODD.findall(text)) + len(_REFERENCE.findall(text)))
    for run in _HIGH.findall(text):
        total += sum(map(char_cost, run))
    return total + sum(len(r) for r in _LATIN_RUN.findall(text)) + unlike(text, LIKE) + unlike(text, BEST) / 10


#: What words never have: a capital with an accent after a small letter, or a symbol among letters or before small ones.
_ODD = re.compile(r"(?<=[a-zß-öø-ÿ])[À-ÖØ-ÞŸŒŠŽ]|(?<=[A-Za-zÀ-ÿœŸ])[¸‰ˆﬂ·‡„‚˘√«∞»´¨˙˚˝˛ˇ‹›§¶®©™¢£•†¿¡³¹¤¦](?=[A-Za-zÀ-ÿœ¸‰ˆﬂ·‡„‚˘√«])|(?<![A-Za-zÀ-ÿ0-9])[¬‚‡√¸‰ˆ„·∞¯÷](?=[a-zC])|(?<=[A-ZÀ-Þ])[À-ÖØ-Þ](?=[a-z])|[\u2580-\u259f\u2550-\u256c](?=[a-zа-я])|(?<=[a-zа-я])[\u2500-\u259f]")


def _decoded(span: str, table: dict[str, int]) -> str | None:
    try:
        ch = bytes(table[c] for c in span).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return ch if unicodedata.category(ch) not in ("Cn", "Co", "Cs") else None


def _strong(span: str, ch: str) -> bool:
    """Whether the span by itself shows that it was read wrongly: it has a control character, or stands for a plausible, cheaper one."""
    if any("\x80" <= c < "\xa0" for c in span):
        return True
    return len(span) > 2 or (char_cost(ch) < 3 and sum(map(char_cost, span)) > char_cost(ch))


#: Second characters of a span that stand behind capitals in ordinary text too.
_USUAL_AFTER = set("’“”‘–—…•«»°²³·µ½©®™ ")


def _rare_ok(span: str, page: str) -> bool:
    """Whether a span of a rare character can't be ordinary text."""
    if page in ("cp437", "cp850"):
        return not 0x2500 <= ord(span[1]) <= 0x257F
    if page == "cp1252":
        return span[1] not in _USUAL_AFTER and not span[1].isalpha()
    return page == "cp1251"


def undo_utf8(text: str, page: str, rare: bool = False) -> str:
    """The text with its spans that are UTF-8 read with this page decoded.

    Spans that decode to rare characters are taken next to a clear one, or by themselves where rare is set, and only if they can't be
    ordinary text. Cyrillic spans must be whole words: a letter next to them that is in no span shows that the text is as it stands.
    """
    table, spans = _TABLES[page], _SPANS[page]
    found: list[tuple[int, int, str, bool]] = []
    for m in spans.finditer(text):
        ch = _decoded(m[0], table)
        if ch is not None:
            found.append((m.start(), m.end(), ch, _strong(m[0], ch)))
    if page in ("cp1251", "koi8_r"):
        runs: list[list[tuple[int, int, str, bool]]] = []
        for s in found:
            if runs and runs[-1][-1][1] == s[0]:
                runs[-1].append(s)
            else:
                runs.append([s])
        alone = lambda i: not (0 <= i < len(text) and _RUSSIAN.match(text[i]))
        found = [s for r in runs if alone(r[0][0] - 1) and alone(r[-1][1]) for s in r]
    if not rare and not any(strong for *_, strong in found):
        return text
    out, at = [], 0
    for start, end, ch, strong in found:
        in_word = not strong and ch.isalpha() and (text[start - 1 : start].isalpha() or text[end : end + 1].isalpha()) and not any(e == start or b == end for b, e, *_ in found)
        if strong or (not in_word and _rare_ok(text[start:end], page)):
            out += text[at:start], ch
            at = end
    return "".join(out) + text[at:]


def _rereadings() -> list[tuple[frozenset[str], dict[int, str], float, bool]]:
    """For every page read and written: the characters it applies to, what each becomes, the step's price, and whether what was written
    is of a script of its own."""
    out = []
    for read in READ:
        table = _page(read)
        for script, pages in WRITTEN.items():
            for written in pages:
                if written == read:
                    continue
                new = {}
                for ch, b in table.items():
                    try:
                        new[ord(ch)] = bytes([b]).decode(written)
                    except UnicodeDecodeError:
                        continue
                usual = script == "cyrillic" or (script == "latin" and read in ("mac_roman", "cp437", "cp850"))
                out.append((frozenset(map(chr, new)), new, 0.0 if usual else 2.0, script in ("cyrillic", "greek")))
    return out


_REREAD = _rereadings()
_READ_TABLES = [_page(r) for r in ("cp1252", "mac_roman", "cp437", "cp850")]


def rereadings(text: str, whole: bool) -> Iterator[tuple[str, float]]:
    """The text as a whole written in one single-byte or double-byte page and read with another, undone, with the step's price.

    Without whole, only into text of a script of its own: part of an accented text is read rightly then. Nothing odd may be left.
    """
    beyond = frozenset(c for c in text if c > "\x7f")
    for characters, new, price, own_script in _REREAD:
        if (whole or own_script) and beyond <= characters:
            turned = text.translate(new)
            if own_language(turned) if own_script else not odd(turned):
                yield turned, price
    if len(beyond) > 2:
        for table in _READ_TABLES:
            if all(c in table for c in beyond):
                raw = bytes(table.get(c) or ord(c) for c in text)
                for page in DOUBLE:
                    try:
                        turned = raw.decode(page)
                    except UnicodeDecodeError:
                        continue
                    if 4 * len(_KANA.findall(turned)) >= sum(c > "\x7f" for c in turned):
                        yield turned, 2.0


def valid_share(text: str) -> float:
    """The share of the characters beyond ASCII that are valid sequences under one of the pages, the most that one has."""
    beyond = sum(c > "\x7f" for c in text)
    return max(sum(len(m[0]) for m in _SPANS[p].finditer(text) if _decoded(m[0], _TABLES[p])) for p in PAGES) / max(1, beyond)


def unescape(text: str) -> str:
    """Character references resolved that stand for one character beyond ASCII."""
    return _REFERENCE.sub(lambda m: u if len(u := html.unescape(m[0])) == 1 and ord(u) > 0x7F else m[0], text)


_STEPS: list[Callable[[str], str]] = [*(lambda t, p=p: undo_utf8(t, p) for p in PAGES), unescape]
#: Pages whose spans of rare characters count by themselves where no other step applies; such a span is worth RARE.
_RARE_PAGES, RARE = ("cp1252", "cp437", "cp850"), 2.0


def _next(state: str, at: float) -> Iterator[tuple[str, float]]:
    """The texts one step away that are no dearer, with their cost and the step's price."""
    any_step = False
    for step in _STEPS:
        new = step(state)
        if new != state and (c := cost(new)) <= at:
            any_step = True
            yield new, c
    # only what is odd as it stands; what is nearly all valid sequences was written in UTF-8
    if odd(state) and valid_share(state) <= 0.5:
        for new, price in rereadings(state, not any_step):
            if (c := cost(new) + price) < at:
                any_step = True
                yield new, c
    if not any_step:
        for page in _RARE_PAGES:
            new = undo_utf8(state, page, rare=True)
            if new != state and (c := cost(new) - RARE) <= at:
                yield new, c


def _search(text: str) -> str:
    """The cheapest text that steps reach from one part; the part itself if none is cheaper."""
    best, least, order = text, cost(text), 0
    visited = {hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()}
    frontier = [(least, 0, text)]
    while frontier:
        c, _, state = heapq.heappop(frontier)
        if c < least or (c == least and state is not text):
            best, least = state, c
        for new, now in _next(state, c):
            key = hashlib.md5(new.encode("utf-8", "surrogatepass")).digest()
            if key not in visited:
                visited.add(key)
                order += 1
                heapq.heappush(frontier, (now, order, new))
    return best


def _suspect(part: str) -> bool:
    """Whether a step could apply to a part."""
    if part.isascii():
        return bool(_REFERENCE.search(part))
    return bool(_ANY_SPAN.search(part) or _REFERENCE.search(part)) or odd(part)


def restore(text: str) -> str:
    """The text with each of its garbled parts replaced by the cheapest text that the search reaches from it."""
    return "".join(_search(p) if _suspect(p) else p for p in _CUT.split(text))


RESTORED = "doc_id bigint, restored string"


def _restore_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        ids, texts = [], []
        for i, t in zip(part["doc_id"], part["text"], strict=True):
            r = None if LOST in t else restore(t)
            if r != t:
                ids.append(i)
                texts.append(r)
        yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "restored": pd.Series(texts, dtype="object")})


def restore_corpus(documents: DataFrame) -> DataFrame:
    """(doc_id, restored) of the texts of documents (doc_id, text) that are garbled; restored is null where characters were lost.

    Null and empty texts, and ASCII ones without character references, aren't looked at beyond that. Equal texts are restored each;
    extra columns are ignored.
    """
    ship(documents.sparkSession)
    beyond = documents.select("doc_id", "text").filter((F.length("text") != F.octet_length("text")) | F.col("text").rlike(_REFERENCE.pattern))
    return spread(beyond).mapInPandas(_restore_all, RESTORED)


def garbled(documents: DataFrame) -> DataFrame:
    """p8: (doc_id, restored_md5), one row per garbled text: the md5 of its restored text's UTF-8 bytes, '' where characters were lost."""
    return restore_corpus(documents).select("doc_id", F.coalesce(F.md5(F.encode("restored", "UTF-8")), F.lit("")).alias("restored_md5"))
