"""Detection and repair of text that was decoded with a wrong character encoding.

Plain Python on one text at a time; ``mojibake.py`` runs it over a DataFrame in Arrow batches.

Method: round-trip repair. A piece of text is re-encoded under a candidate *wrong* encoding and
strictly decoded under the *intended* one; the result is accepted when the garbling cost drops.
The passes repeat until nothing changes, so nested layers come off one by one.

Three families of damage are told apart:

* UTF-8 read as an 8-bit code page (or as GBK, Big5, Shift-JIS): every multi-byte sequence is a
  run of characters with a fixed shape, found by one regular expression per code page.
* A legacy encoding (Cyrillic, Greek, Japanese, Chinese, Korean, Mac) read as Western European.
* Bytes that were already lost: U+FFFD, also after it was garbled once more.
"""

from __future__ import annotations

import codecs
import html
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

LOST = "�"

#: Code pages under which UTF-8 bytes may have been read, the likeliest first.
SINGLE_BYTE = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "mac_roman", "cp866", "koi8_r")
MULTI_BYTE = ("gbk", "big5", "cp932", "euc_kr")


def _chars(codec: str) -> list[str]:
    """The character each byte 0x80..0xFF shows as; a byte without one shows as the C1 control."""
    out = []
    for b in range(0x80, 0x100):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@dataclass(frozen=True)
class _Page:
    name: str
    to_byte: dict[int, int]
    sequence: re.Pattern
    #: A lead and a trail byte: cheap to look for, and in every sequence. The characters of both are cheaper still.
    pair: re.Pattern
    leads: frozenset
    trails: frozenset
    latin: bool


def _class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


@lru_cache(maxsize=None)
def _page(codec: str) -> _Page:
    shown = _chars(codec)
    to_byte = {ord(c): 0x80 + i for i, c in enumerate(shown)}
    cont, extra = list(shown[:0x40]), []
    if codec in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257"):
        for b in range(0x80, 0xA0):  # the same page read as ISO 8859 keeps the C1 controls
            if chr(b) not in to_byte and b not in to_byte:
                to_byte[b] = b
                extra.append(chr(b))
    cont += extra
    c = _class(cont)
    two, three, four = (_class(shown[a - 0x80 : z - 0x7F]) for a, z in ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4)))
    latin = codec not in ("cp1251", "cp1253", "cp866", "koi8_r")
    return _Page(codec, to_byte, re.compile(f"(?:{four}{c}{{3}}|{three}{c}{{2}}|{two}{c})+"), re.compile(_class(shown[0x42:0x75]) + c), frozenset(shown[0x42:0x75]), frozenset(cont), latin)


def _ranges(*pairs: tuple[int, int]) -> re.Pattern:
    return re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in pairs) + "]")


#: Characters that people write: what a sequence decodes to must be among them.
_PLAUSIBLE = _ranges(
    (0x80, 0x17F), (0x192, 0x192), (0x218, 0x21B), (0x2C6, 0x2C7), (0x2D8, 0x2DD), (0x300, 0x304), (0x306, 0x30C), (0x327, 0x328), (0x384, 0x3CE), (0x400, 0x45F), (0x490, 0x491),
    (0x5D0, 0x5EA), (0x621, 0x652), (0x660, 0x669), (0xE01, 0xE5B), (0x1E00, 0x1EFF), (0x200B, 0x2044), (0x2070, 0x209F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2150, 0x218B),
    (0x2190, 0x22FF), (0x2300, 0x23FF), (0x2460, 0x24FF), (0x2500, 0x27BF), (0x2900, 0x297F), (0x2B00, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
    (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFE00, 0xFE0F), (0xFE30, 0xFE4F), (0xFEFF, 0xFEFF), (0xFF01, 0xFFEE), (0xFFFD, 0xFFFD), (0x1F000, 0x1FAFF), (0x20000, 0x2FA1F), (0xE0020, 0xE007F),
)
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
#: Marks that may follow a shouted word: behind a capital letter they say nothing about its encoding.
_CLOSING_LATIN = set("’”“‘…»›–—\xa0„‚")
_CLOSING = set("’”“‘…»›–—°©®·§№\xa0„‚«™•")
_REFERENCE = r"&(?:[A-Za-z]{2,8}\d{0,2}|#\d{2,5}|#x[0-9A-Fa-f]{2,5});"
#: Character references and characters beyond ASCII side by side.
_ENTITY_RUN = re.compile(f"(?:{_REFERENCE}|[\x80-\U0010ffff])+")


def _plausible(new: str) -> bool:
    return all(_PLAUSIBLE.match(c) for c in new if c > "\x7f")


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "L" if c.isalpha() else ""
    if 0x370 <= o < 0x400:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    return "X" if c.isalpha() else ""


def _sequence_is_garbled(text: str, start: int, end: int, new: str, page: _Page) -> bool:
    """Whether reading text[start:end] as ``new`` lowers the garbling cost."""
    if not _plausible(new):
        return False
    old = text[start:end]
    if page.name == "koi8_r" and all(c.isalpha() for c in old):  # ё is the only letter among its trail bytes
        return False
    if page.name == "cp866":  # its lead bytes of three are small letters, so a trail must be a capital or a frame
        leads = [c for c in new if c > "\u07ff"]
        if len(new) == 1 and leads and not "‐" <= new <= "₿":
            return False
        if leads and not all(any(t.isupper() or not t.isalpha() for t in c.encode("utf-8").decode("cp866")[1:]) for c in leads):
            return False
    if page.name == "cp850" and old.isalpha() and len(new) < 3 and not all("‐" <= c <= "➿" for c in new):
        return False  # here the lead bytes of Cyrillic and Greek are letters
    if len(new) > 1 or len(old) > 2:
        if page.name in ("mac_roman", "cp850") and len(new) == 1 and old.isalpha() and not "‐" <= new <= "➿":
            return False
        return True
    before, after = text[start - 1 : start], text[end : end + 1]
    lead, tail = old
    if page.name == "mac_roman" and (lead in "–—" and (tail.isalpha() or tail in "£¢") or _page("cp1252").sequence.fullmatch(old)):
        return False  # a dash before an accented letter, or what the commoner page reads too
    if tail in (_CLOSING_LATIN if page.latin else _CLOSING) or (tail.isalpha() and tail.isupper()):
        same = lambda c: bool(c) and c.isalpha() and _script(c) == _script(lead)
        if page.latin and same(before) and after.isalpha() and after.islower():  # shouted words go on in capitals, if at all
            return True
        if same(before) and (before.isupper() or not page.latin):
            return False
        if page.latin:
            if same(before) and before.islower() and tail in "”»…’" and lead in "ßÞ":
                return False
            return not (tail in "’”…»\xa0–—" and not before.isalpha() and not after.isalpha() and lead not in "ÂÃÄÅĂĹ")
        if not before.isalpha() and (not after.isalpha() or _script(after) == _script(lead)):
            return tail not in _CLOSING and not (after and after.isupper())
    return True


_HIGH_RUN = re.compile("[^\\x00-\\x7f]+")


def _own(text: str, found: list[re.Match]) -> list[re.Match]:
    """Without the sequences in long runs of high characters that they explain only in part: another encoding's bytes, see _decode_wide."""
    out, i = [], 0
    while i < len(found):
        begin = found[i].start()
        while begin and text[begin - 1] > "\x7f":
            begin -= 1
        end, first, covered = _HIGH_RUN.match(text, begin).end(), i, 0
        while i < len(found) and found[i].start() < end:
            covered += found[i].end() - found[i].start()
            i += 1
        if end - begin < 6 or covered >= 0.85 * (end - begin):
            out += found[first:i]
    return out


def _decode_sequences(text: str, page: _Page) -> tuple[str, int]:
    n, out, at = 0, [], 0
    found = list(page.sequence.finditer(text))
    for m in _own(text, found) if found else found:
        raw = bytes(page.to_byte[ord(c)] for c in m.group())
        try:
            new = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if _sequence_is_garbled(text, m.start(), m.end(), new, page):
            out += [text[at : m.start()], new]
            at = m.end()
            n += 1
    return ("".join([*out, text[at:]]), n) if n else (text, 0)


# ---------------------------------------------------------------- UTF-8 read as a double-byte code
_CJK = "\u2e80-\u9fff\uac00-\ud7a3\ue000-\uf8ff\uf900-\ufaff\ufe30-\uff9f"
_EAST = re.compile(f"[{_CJK}]+")
_TRAILED = re.compile(f"[{_CJK}][{_CJK}\ufffd\u20ac\x21-\x7e\xa4-\xf7\u2010-\u203b\u0370-\u0451\u2100-\u214f\u2190-\u266f]*")


_LATIN_LETTER = re.compile("[À-ÖØ-öø-ž]")


def _longest_utf8(raw: bytes) -> tuple[int, int, str] | None:
    """The part of raw that is strict UTF-8, allowing cut characters at both ends: start, end, text."""
    for start in range(min(3, len(raw))):
        try:
            return start, len(raw), raw[start:].decode("utf-8")
        except UnicodeDecodeError as e:
            end = start + e.start  # what is before the first damage is strict
            if end > start and len(raw) - end <= 3:
                return start, end, raw[start:end].decode("utf-8")
    return None


def _decode_east(text: str) -> tuple[str, int]:
    """Runs of East Asian characters that are UTF-8 once re-encoded."""
    n = 0

    def put(m: re.Match) -> str:
        nonlocal n
        run = m.group()
        out = []
        for piece in re.split("(�|\\?+)", run):
            new = _one_east(piece, text, m.start(), len(run)) if piece else None
            if new is None and piece:
                new = _east_parts(piece)
            out.append(piece if new is None else new)
            n += new is not None
        return "".join(out)

    new = _TRAILED.sub(put, text)
    return (new, n) if n else (text, 0)


def _one_east(piece: str, text: str, at: int, run: int) -> str | None:
    high = sum(c > "\x7f" for c in piece)
    if high < 1 or not _EAST.search(piece):
        return None
    for codec in MULTI_BYTE:
        try:
            raw = piece.encode(codec)
        except UnicodeEncodeError:
            continue
        found = _longest_utf8(raw)
        if not found:
            continue
        start, end, new = found
        wide = sum(c > "\x7f" for c in new)
        if not _plausible(new) or "\x80" <= min((c for c in new if c > "\x7f"), default="\x80") < "\xa0":
            continue
        whole = start == 0 and end == len(raw)
        if high >= 5 and wide >= 3 and (end - start) >= 0.8 * len(raw) or whole and high >= 4 and wide >= 2:
            return (LOST if start else "") + new + (LOST if end < len(raw) else "")
        if whole and high <= 3 and wide and all(_LATIN_LETTER.match(c) for c in new if c > "\x7f") and re.match("[A-Za-z]", text[at - 1 : at] or " "):
            return new  # a letter of a word in Latin script
        if whole and wide and high <= 3:  # a few in a text of another script, such as an apostrophe
            near = text[max(0, at - 12) : at] + text[at + run : at + run + 12]
            if re.search("[A-Za-zÀ-ɏͰ-ԯ]", text[max(0, at - 1) : at] + new[-1:] + text[at + run : at + run + 1]) and not _EAST.search(near):
                return new
    return None


codecs.register_error("mergestone_mark", lambda e: (b"\xff" * (e.end - e.start), e.end))
#: Four or more letters of two bytes each in one alphabet, or two or more characters of three bytes, with ASCII signs between them.
#: All that it matches is strict UTF-8: \xed with a trail from \xa0 on would be half a surrogate pair.
_UTF8_PART = re.compile(rb"(?:(?:[\xe2-\xec\xee\xef][\x80-\xbf]|\xed[\x80-\x9f])[\x80-\xbf][\x20-\x7e]{0,2}){2,}|(?:[\xd0\xd1][\x80-\xbf][\x20-\x7e]{0,2}){4,}|(?:[\xce\xcf][\x80-\xbf][\x20-\x7e]{0,2}){4,}")
_KANA_OR_MARK = re.compile("[\u3000-\u30ff\uff01-\uff5e\u2010-\u2027]")


@lru_cache(maxsize=20_000)
def _everyday(c: str) -> bool:
    """Whether a character is in the first level of the Chinese or the Japanese standard."""
    for codec, last in (("gb2312", 0xD7), ("euc_jp", 0xCF)):
        try:
            if 0xB0 <= c.encode(codec)[0] <= last:
                return True
        except UnicodeEncodeError:
            pass
    return False


def _uncommon(text: str) -> float:
    """The share of a text's high characters that are no everyday Chinese, Japanese, Korean, Cyrillic or Greek."""
    high = [c for c in text if c > "\x7f"]
    odd = 0
    for c in high:
        if _KANA_OR_MARK.match(c) or "가" <= c <= "힣" or "Ѐ" <= c <= "ё" or "Ά" <= c <= "ώ":
            continue
        odd += not _everyday(c)
    return odd / len(high) if high else 1.0


def _east_parts(piece: str) -> str | None:
    """Stretches inside a run of East Asian characters that are UTF-8 once re-encoded, beside characters that are as they should be.

    Each code is tried on the whole run at once. A stretch counts if the characters it decodes to are commoner than those
    it shows as; a character that it shares with what follows is lost.
    """
    best = None
    for codec in MULTI_BYTE:
        raw = piece.encode(codec, "mergestone_mark")
        found = list(_UTF8_PART.finditer(raw))
        if not found:
            continue
        ends = list(accumulate(len(c.encode(codec, "mergestone_mark")) for c in piece))
        out, at, gain = [], 0, 0.0
        for m in found:
            new = m.group().decode("utf-8").rstrip()
            start, end = m.start(), m.start() + len(new.encode())
            i = bisect_left(ends, start + 1)  # the character that holds the first byte, and the one behind the last
            j = bisect_left(ends, end) + 1
            if i < at or (ends[i - 1] if i else 0) != start or not _plausible(new) or new[:1] < "\u0800" and len(set(new)) < 4:
                continue
            drop = _uncommon(piece[i:j]) - _uncommon(new)
            # five letters of one alphabet in a row don't come about by chance
            if drop < (0.01 if new[:1] < "\u0800" and len(new) >= 5 else 0.25):
                continue
            out += [piece[at:i], new, LOST if ends[j - 1] != end else ""]
            at, gain = j, gain + drop * len(new)
        if out and (best is None or gain > best[0]):
            best = gain, "".join([*out, piece[at:]])
    return best[1] if best else None


# ---------------------------------------------------------------- legacy encodings read as Western European
_WEST = _page("cp1252").to_byte
_WEST_CLASS = "".join(re.escape(chr(c)) for c in _WEST)
_WEST_SEGMENT = re.compile(f"[\x20-\x7e\t{_WEST_CLASS}]+")
_THREE_HIGH = re.compile(f"[{_WEST_CLASS}]{{3}}")
_LETTERS_3 = re.compile("[À-ÖØ-öø-ÿ¸¨][À-ÖØ-öø-ÿ¸¨]{2}")
_SHIFT_JIS = re.compile("(?:[‚ƒ][\x40-\x7e\x80-\U0001ffff]){2}")
_WIDE = ("cp1251", "cp1253", "iso8859_7", "koi8_r", "cp866", "euc_jp", "gbk", "cp932", "big5", "euc_kr")
_ALPHABETS = {"cp1251", "cp1253", "iso8859_7", "koi8_r", "cp866"}
_MIXED = re.compile("[A-Za-z][^\\W\\d_\x00-\x7f]|[^\\W\\d_\x00-\x7f][A-Za-z]")
_MARK_RUN = re.compile("^[‘’“”…»«–—°·•€£¡¿!?\xa0]+$")


def _wide_cost(new: str, codec: str) -> float:
    """0 for an ordinary text of the codec's script, 1 for noise."""
    high = [c for c in new if c > "\x7f"]
    if not high:
        return 1.0
    if codec in ("cp1251", "koi8_r", "cp866"):
        good = sum("а" <= c <= "я" or "А" <= c <= "Я" or c in "ёЁ–—«»„“”’№°…" for c in high)
        bad = len(re.findall("[а-яё][А-ЯЁ]", new))
    elif codec in ("cp1253", "iso8859_7"):
        good = sum("Ά" <= c <= "ώ" or c in "–—«»“”’°…·" for c in high)
        bad = len(re.findall("[α-ωά-ώ][Α-Ω]", new))
    elif codec in ("euc_jp", "gbk") and all("Ѐ" <= c <= "ӿ" for c in high):  # their Cyrillic rows
        good, bad = len(high), len(re.findall("[а-яё][А-ЯЁ]", new))
    elif codec in ("euc_jp", "cp932"):
        good = sum("　" <= c <= "ヿ" or "一" <= c <= "鿿" or "！" <= c <= "～" for c in high)
        bad = 0.5 * len(high) if not re.search("[ぁ-ヾ]", new) else 0
    elif codec == "euc_kr":
        good, bad = sum("가" <= c <= "힣" or c in "。，、" for c in high), 0
    else:
        common = 0
        for c in high:
            try:
                common += c in "，。：；！？、（）“”《》" or 0xB0 <= c.encode("gb2312")[0] <= 0xD7
            except UnicodeEncodeError:
                pass
        good, bad = common, 0.3 * len(high) if codec == "big5" else 0
    bad += len(_MIXED.findall(new)) * (2 if codec in _ALPHABETS else 1)
    return min(1.0, 1 - (good - bad) / len(high))


def _strict_parts(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


def _best_wide(part: str, least: float, glued: bool = False) -> str | None:
    """The reading of part under the legacy encoding of the least cost below ``least``; few letters that belong to an ASCII word
    or show how UTF-8 begins (``glued``) are no word of another alphabet."""
    high = sum(c > "\x7f" for c in part)
    if high < 4:
        return None
    raw, best = bytes(b if (b := ord(c)) < 0x80 else _WEST[b] for c in part), None
    for codec in _WIDE:
        if glued and high < 8 and codec in _ALPHABETS:
            continue
        new = _strict_parts(raw, codec)
        if new is not None and (c := _wide_cost(new, codec)) < least:
            best, least = new, c
    return best


def _decode_wide(text: str) -> tuple[str, int]:
    n = 0

    def put(m: re.Match) -> str:
        nonlocal n
        seg = m.group()
        hits = [x.group() for x in _THREE_HIGH.finditer(seg)]
        hits = [x for x in hits if not _MARK_RUN.match(x) and len(set(x)) > 1]
        if not hits and not _SHIFT_JIS.search(seg):
            return seg
        # the whole segment, then from its first to its last high character, then each of its dense parts
        high = [i for i, c in enumerate(seg) if c > "\x7f"]
        first, last = high[0], high[-1] + 1
        for start, end, least in ((0, len(seg), 0.25), (first, last, 0.25 - 0.02 * (first + len(seg) - last) / len(seg))):
            new = _best_wide(seg[start:end], least)
            if new is not None:
                n += 1
                return seg[:start] + new + seg[end:]
        out, at = [], 0
        for start, end in _dense(high):
            least = 0.25 - 0.02 * (start + len(seg) - end) / len(seg)
            for stop in (end, min(len(seg), end + 1)):  # the last character's second byte may be ASCII
                new = _best_wide(seg[start:stop], least, seg[start - 1 : start].isalpha() or seg[stop : stop + 1].isalpha() or bool(_FRAGMENTS.search(seg, start, stop)))
                if new is not None:
                    n += 1
                    out += [seg[at:start], new]
                    at = stop
                    break
        return "".join([*out, seg[at:]])

    new = _WEST_SEGMENT.sub(put, text)
    return (new, n) if n else (text, 0)


def _dense(high: list[int]) -> list[tuple[int, int]]:
    """Stretches of a segment with its high characters at most 12 places apart."""
    runs, begin = [], high[0]
    for a, b in zip(high, high[1:]):
        if b - a > 12:
            runs.append((begin, a + 1))
            begin = b
    runs.append((begin, high[-1] + 1))
    return runs


#: A word of Western letters only, none of them ASCII.
_ACCENTED_WORD = re.compile("(?<![A-Za-zÀ-ÖØ-öø-ÿ¸¨])[À-ÖØ-öø-ÿ¸¨]{2,}(?![A-Za-zÀ-ÖØ-öø-ÿ¸¨])")
_ACCENTED_LETTERS = frozenset(chr(c) for c in range(0xC0, 0x100)) | {"¸", "¨"}
_CONTEXT = (("cp1251", re.compile("[А-яё]"), re.compile("[А-ЯЁ]?[а-яё]+")), ("cp1253", re.compile("[Ά-ώ]"), re.compile("[Ά-Ϋ]?[ά-ώ]+")))


def _decode_words(text: str) -> tuple[str, int]:
    """Single words in a text of another script that belong to that script once decoded."""
    n = 0
    for codec, script, word in _CONTEXT:
        if len(script.findall(text)) < 20:
            continue

        def put(m: re.Match, codec: str = codec, word: re.Pattern = word) -> str:
            nonlocal n
            new = _strict_parts(bytes(_WEST[ord(c)] for c in m.group()), codec)
            if new is None or not word.fullmatch(new):
                return m.group()
            n += 1
            return new

        text = _ACCENTED_WORD.sub(put, text)
    return text, n


#: What stands inside a word only when a letter was misread: a mark between letters, a capital between small letters.
_MARKS = "‡†ˆ‰‹›•™¢£¤¥¦§¨©ª¬®¯±²³¹¶¸»«¼½¾¿¡÷ƒ„‚˜“”"
#: Each pattern begins with the class of its signs, by which the search skips to them; what stands before them is looked at then.
_ODD = re.compile(
    f"[{_MARKS}À-ÖØ-ÞŠŒŽŸýðþœñê](?:"
    f"(?<=[A-Za-zß-öø-ÿ][{_MARKS}])(?=[A-Za-zß-öø-ÿ³±¹¶¿¼¾])"
    "|(?<=[a-zß-öø-ÿ][À-ÖØ-ÞŠŒŽŸ])(?=[a-zß-öø-ÿ])"
    "|(?<=[A-Z][ŠŽŸ])(?=[a-z])"
    "|(?<=[ÒÔ])(?<![A-Za-zÀ-ÿ][ÒÔ])(?=[A-Za-z][a-z ]*[ÓÕ](?![a-zà-ÿ]))"
    "|(?<=[a-z][‡ˆ‰‹›Ž])(?![A-Za-z0-9‡ˆ‰‹›])"
    "|(?<=³)(?<![0-9A-Za-zÀ-ÿ]³)(?=[a-zó])"
    "|(?<=IÕ)(?=(?:d|m|ll|ve) )"
    "|(?<=[a-z][a-z][a-z]ª)(?![A-Za-z])|(?<=[a-z]³)(?=¹)|(?<=[a-z][±¶])(?![A-Za-z0-9])"
    "|(?<=[a-z]œ)(?=[bcdgkmnpwz])"
    "|(?<=[a-zó]ñ)(?=[bcdfgklmnprstwz])|(?<=[a-z]ê)(?=dz)|(?<=[a-z]{5}³)(?![A-Za-z0-9])"
    "|(?<=[0-9] Û)(?![A-Za-z])|(?<=[a-zà-ÿ] ˆ)(?= [a-zà-ÿ])"
    "|(?<= Ð)(?= )|(?<=[a-z] Ñ)(?= [A-Za-z])"
    "|(?<=[a-zçöüâ][ýðþ])(?![áéíóúæ])|(?<=Þ)(?<![A-Za-zÀ-ÿ]Þ)(?=[a-zý])(?![óo]rr?)"
    ")"
)
#: A dash in or behind a word: a sign only in a text that has accented letters.
_ODD_DASH = re.compile("[—–](?:(?<=[a-zà-ÿ][—–])(?=[a-zà-ÿ—–])|(?<=[a-zà-ÿ]—)(?= [a-z]))")
_ACCENTED = re.compile("[à-öø-ÿ]")
_NARROW = ("mac_roman", "cp1250", "iso8859_2", "cp437", "cp850", "cp1254")
_NARROW_LETTERS = {
    "mac_roman": set("áàâäãåéèêëíìîïóòôöõúùûüçñßÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑœŒæÆøØ–—‘’“”…°£€«»¿¡©®™ﬁﬂ"),
    "cp1250": set("ąćęłńóśźżĄĆĘŁŃÓŚŹŻáéíúůýčďěňřšťžÁÉÍÚÝČĎĚŇŘŠŤŽäöüßÄÖÜőűŐŰ–—‘’“”„…°€«»"),
    "iso8859_2": set("ąćęłńóśźżĄĆĘŁŃÓŚŹŻáéíúůýčďěňřšťžÁÉÍÚÝČĎĚŇŘŠŤŽäöüßÄÖÜőűŐŰ°\xa0"),
    "cp437": set("áàâäåéèêëíìîïóòôöúùûüçñßÄÅÉÖÜÇÑæÆ°£¿¡«»"),
    "cp850": set("áàâäãåéèêëíìîïóòôöõúùûüçñßÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑæÆøØ°£¿¡«»"),
    "cp1254": set("ğşıİĞŞçöüÇÖÜâîû–—‘’“”…°€£§"),
}


def _odd(text: str, dashes: bool) -> int:
    return len(_ODD.findall(text)) + (len(_ODD_DASH.findall(text)) if dashes else 0)


def _one_narrow(seg: str, dashes: bool) -> str | None:
    best, cost = None, _odd(seg, dashes) - 0.5
    for codec in _NARROW:
        raw = bytes(b if (b := ord(c)) < 0x80 else _WEST[b] for c in seg)
        new = _strict_parts(raw, codec)
        if new is None or not all(c in _NARROW_LETTERS[codec] for c in new if c > "\x7f"):
            continue
        if (c := _odd(new, dashes)) < cost:
            best, cost = new, c
    return best


_WORD = re.compile("[^ \\n\\t]+")


def _decode_narrow(text: str) -> tuple[str, int]:
    """Lines, or else single words, of a Western text whose letters show as marks or as letters of other languages."""
    n, dashes = 0, bool(_ACCENTED.search(text))

    def put(m: re.Match) -> str:
        nonlocal n
        seg = m.group()
        if seg == "ˆ" and m.re is _WORD and dashes:  # à as Mac Roman shows it
            n += 1
            return "à"
        if not _odd(seg, dashes):
            return seg
        new = _one_narrow(seg, dashes)
        if new is None and m.re is _WEST_SEGMENT:
            return _WORD.sub(put, seg)
        if new is None:
            return seg
        n += 1
        return new

    new = _WEST_SEGMENT.sub(put, text)
    return (new, n) if n else (text, 0)


# ---------------------------------------------------------------- one Cyrillic encoding read as another
_CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")
_CYRILLIC_RUN = re.compile("[\u0400-\u052f][\u0400-\u052f ,:;()0-9\x80-\xbf\u2010-\u2044\u20ac\u2116\u2122\u2500-\u257f-]{7,}")
#: A word of letters and marks, as the common Cyrillic pages show each other's letters.
_CYRILLIC_WORD = re.compile("[^\x00-\x7f]{3,}")
_RUSSIAN_WORD = re.compile("[А-ЯЁа-яё]+")
_CYRILLIC_LETTER = re.compile("[Ѐ-ԯ]")
_TURN = re.compile("[а-яё][А-ЯЁ]")
_INNER_CAPITAL = re.compile("(?<=[Ѐ-ҁ])[А-ЯЁ]")


_SELDOM = re.compile(_class([c for c in map(chr, range(0x400, 0x530)) if c.lower() not in "оеаинтсрвлкмдпу"]))
_FRAMES = re.compile("[─-╿¤¦§©¬®¶±†‡€‰‹›]")


def _cyrillic_cost(text: str) -> float:
    """Letters that Russian uses little, capitals inside words, frames and marks between letters."""
    odd = len(_SELDOM.findall(text))
    marks = len(_FRAMES.findall(text))
    return odd + marks + 0.5 * len(_INNER_CAPITAL.findall(text)) + len(_TURN.findall(text))


#: Capitals only, or capitals behind a small letter: how KOI8 shows small letters, and a capital one before them, as cp1251.
_SHOUTED_WORD = re.compile("[А-ЯЁЈ]{4,}|[а-яё][А-ЯЁЈ]{2,}")
_SMALL = re.compile("[а-яё]")
_CAPITAL = re.compile("[А-ЯЁ]")


def _vowels(word: str) -> float:
    return sum(c in "аеёиоуыэюя" for c in word.lower()) / len(word)


def _calm(word: str) -> str | None:
    """A shouted word read as KOI8, if that has the vowels and the common letters that the word itself lacks."""
    try:
        new = word.encode("cp1251").decode("koi8_r")
    except UnicodeError:
        return None
    if not re.fullmatch("[А-ЯЁ]?[а-яё]+", new):
        return None
    share = lambda w: sum(c not in "оеаинтсрвлкмдпу" for c in w.lower()) / len(w)
    if share(new) > 0.4 or _vowels(new) < 0.3:
        return None
    # a small letter before capitals is odd by itself
    return new if word[0].islower() or share(new) < share(word) and _vowels(word) < 0.3 else None


def _decode_cyrillic(text: str) -> tuple[str, int]:
    n = 0
    mostly_small = len(_SMALL.findall(text)) >= max(20, 2 * len(_CAPITAL.findall(text)))

    def put(m: re.Match) -> str:
        nonlocal n
        run = m.group()
        letters = sum("Ѐ" <= c <= "ԯ" for c in run)
        old = _cyrillic_cost(run)
        if letters < 8 or old < 0.45 * letters:
            return run
        best, cost = None, min(old * 0.6, 0.4 * letters)
        for wrong in _CYRILLIC:
            try:
                raw = run.encode(wrong)
            except UnicodeEncodeError:
                continue
            for right in _CYRILLIC:
                new = _strict_parts(raw, right) if right != wrong else None
                if new is None or sum("Ѐ" <= c <= "ԯ" for c in new) < 0.9 * letters:
                    continue
                if (c := _cyrillic_cost(new)) < cost:
                    best, cost = new, c
        if best is None:
            return run
        n += 1
        return best

    def put_word(m: re.Match) -> str:
        nonlocal n
        word = m.group()
        if not any("Ѐ" <= c <= "ԯ" for c in word):
            return word
        if _SHOUTED_WORD.fullmatch(word):
            new = _calm(word) if mostly_small else None
            n += new is not None
            return new or word
        if _RUSSIAN_WORD.fullmatch(word):
            return word
        best, cost = None, 0.8 * (sum(not _RUSSIAN_WORD.fullmatch(c) for c in word) + _cyrillic_cost(word))
        for wrong, right in (("cp1251", "cp866"), ("koi8_r", "cp866"), ("cp1251", "mac_cyrillic"), ("mac_cyrillic", "cp1251"), ("cp866", "cp1251")):
            try:
                new = _strict_parts(word.encode(wrong), right)
            except UnicodeEncodeError:
                continue
            if new and _RUSSIAN_WORD.fullmatch(new) and not _TURN.search(new) and (c := _cyrillic_cost(new)) < cost:
                best, cost = new, c
        if best is None:
            return word
        n += 1
        return best

    new = _CYRILLIC_RUN.sub(put, text)
    if not n:
        new = _CYRILLIC_WORD.sub(put_word, text)
    return (new, n) if n else (text, 0)


# ---------------------------------------------------------------- all together
_FRAGMENTS = re.compile("â€|вЂ|ΓÇ|‚Ä[îìúùô¶¢]|ðŸ|рџ|đź|ï¿½|пїЅ|ďż˝|ï»¿|锟斤拷|Ã[ƒ‚]Â|Ð[°-¿][Ð ,.]|Ñ[\x80-\x8f‚ƒ„…†‡ˆ‰Š]")
#: An à whose second half, a no-break space, became an ordinary space.
_A_GRAVE = re.compile("(?<=[a-zß-ÿ] )Ã  ?(?=[a-zß-ÿ])|(?<=[a-zß-ÿ])Ã (?=[ a-zß-ÿ:,.!?]|$)")
_ENTITY = re.compile(r"&(?:[A-Z](?:tilde|circ|uml|grave|acute|ring|elig|cedil);|acirc;|#\d{3,5};|#x[0-9A-Fa-f]{2,5};|szlig;|icirc;|eth;|iuml;)")


@dataclass(frozen=True)
class Repair:
    """found: the text holds garbled characters. lost: some of them can't be restored. layers: passes that changed the text."""

    text: str | None
    found: bool
    lost: bool
    layers: int


@lru_cache(maxsize=1)
def _suspect() -> re.Pattern:
    leads, conts = set(), set()
    for name in SINGLE_BYTE:
        shown = _chars(name)
        leads |= set(shown[0x42:0x75])
        conts |= set(shown[:0x40])
    conts |= {chr(b) for b in range(0x80, 0xA0)}
    return re.compile(_class(sorted(leads)) + _class(sorted(conts)))


def _by_length(text: str, chars: set[str]) -> list[_Page]:
    """The code pages whose sequences occur, those that explain most characters first."""
    found = []
    for i, page in enumerate(map(_page, SINGLE_BYTE)):
        if page.leads.isdisjoint(chars) or page.trails.isdisjoint(chars) or not page.pair.search(text):
            continue
        if covered := sum(map(len, page.sequence.findall(text))):
            found.append((-covered, i, page))
    return [page for _, _, page in sorted(found, key=lambda x: x[:2])]


def _entities(text: str) -> tuple[str, int]:
    """Character references that are garbled characters: replaced only where what they say decodes."""
    if not _ENTITY.search(text):
        return text, 0
    n = 0

    def put(m: re.Match) -> str:
        nonlocal n
        if "&" not in m.group():
            return m.group()
        plain = html.unescape(m.group())
        if plain == m.group() or plain.isascii():
            return m.group()
        new, k = _decode_sequences(plain, _page("cp1252"))
        if not k and not _FRAGMENTS.search(plain):
            return m.group()
        n += 1
        return new

    new = _ENTITY_RUN.sub(put, text)
    return (new, n) if n else (text, 0)


def repair(text: str | None) -> Repair:
    """Finds and undoes wrong decoding in one text.

    A null text, an empty one and one of ASCII only (without character references) come back as they are.
    U+FFFD stays in the repaired text, where the original is lost.
    """
    if not text or text.isascii() and "&" not in text:
        return Repair(text, False, False, 0)
    now, layers, seen = text, 0, {text}
    while True:
        new, n = _entities(now)
        chars = set(new)
        if _suspect().search(new):
            for page in _by_length(new, chars):
                k = 1
                while k and page.pair.search(new):  # layers of one page come off before another page is tried
                    new, k = _decode_sequences(new, page)
                    n += k
        if max(chars) >= "\u2e80" and _EAST.search(new):
            new, k = _decode_east(new)
            n += k
        if not n and (_THREE_HIGH.search(new) or ("‚" in chars or "ƒ" in chars) and _SHIFT_JIS.search(new)):
            new, n = _decode_wide(new)
        if not n and not _ACCENTED_LETTERS.isdisjoint(chars) and _ACCENTED_WORD.search(new):
            new, n = _decode_words(new)
        if not n and _CYRILLIC_LETTER.search(new):
            new, n = _decode_cyrillic(new)
        if not n and (_ODD.search(new) or _ODD_DASH.search(new)):
            new, n = _decode_narrow(new)
        if not n and _C1.search(new):
            fixed = _C1.sub(lambda m: _chars("cp1252")[ord(m.group()) - 0x80], new)
            new, n = fixed, int(fixed != new)
        if not n or new in seen:  # a pass that leads back changes nothing
            break
        seen.add(new)
        now, layers = new, layers + 1
    if "Ã " in now:
        fixed = _A_GRAVE.sub(lambda m: "à " if m.group().endswith("  ") or text[m.start() - 1 : m.start()] == " " else "à", now)
        now, layers = fixed, layers + (fixed != now)
    lost = LOST in now or bool(_C1.search(now)) or bool(_FRAGMENTS.search(now))
    return Repair(now, layers > 0 or lost, lost, layers)
