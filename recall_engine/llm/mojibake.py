"""Problem 7: text that was decoded with the wrong character encoding.

Method: round-trip repair. Text is re-encoded under candidate legacy encodings and strictly decoded as the intended
encoding; this is repeated for nested layers, as many as there are, and a step is accepted when a garbling cost drops.
UTF-8 that was read as a legacy encoding is found sequence by sequence, so passages inside correct text are repaired too.
Text of one legacy encoding read as another is repaired sentence by sentence, with the pair of encodings that lowers the
cost most, and line by line where the script is another one; this also in texts that had layers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recall_engine.llm.words import slices
from recall_engine.plans.tables import spread

#: Encodings UTF-8 may have been read as.
READ_AS = ("cp1252", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "iso8859-15", "cp1254", "koi8-r")
#: (read as, written in) of texts in a legacy encoding that were read as another.
CONFUSED = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("latin-1", "cp850"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("koi8-r", "cp1252"), ("mac_roman", "cp850"), ("cp850", "mac_roman"), ("cp1253", "cp1252"), ("iso8859-5", "cp1252"),
)
#: (read as, written in) of texts in another script.
SCRIPTS = (
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp1253"), ("latin-1", "cp1253"),
    ("latin-1", "shift_jis"), ("cp1252", "shift_jis"), ("latin-1", "euc_jp"), ("cp1252", "euc_jp"), ("latin-1", "gbk"), ("cp1252", "gbk"),
)
#: Cost of a character in a sequence that reads as UTF-8: such sequences hardly ever come by chance.
SEQUENCE = 1.0
#: Drop of the cost at which the reading of a text as another legacy encoding counts as shown.
DROP = 2.0

_LOWER = "àâäçéèêëîïôöùûüÿœæñáíóúß"
_UPPER = "ÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŒÆÑÁÍÓÚ"
_OPEN, _SHUT = "«“„‘¿¡‹", "»”“’›"
_PLAIN = "°²³§©®™£•·№№─│┌┐└┘├┤┬┴┼□■▪●→←↑↓✓–—…’€ºªµ½¼¾  ​﻿ \n"
_MARKS = "‚ˆ˜¨´¸¯†‡‰¬¶±√∞∂∑∏π∫≈∆◊⁄¦¤¢¥ƒ×÷¹ﬁﬂ≠≤≥"


def _table(encoding: str) -> list[list[str]]:
    """Characters each byte from 0x80 may have become; an undefined one stays a control character, as does any in cp1252."""
    out = []
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.append([c, chr(b)] if encoding == "cp1252" and b < 0xA0 and c != chr(b) else [c])
    return out


@lru_cache(1)
def _readers() -> list[tuple[str, re.Pattern, dict[str, int]]]:
    out = []
    for name in READ_AS:
        table = _table(name)
        one = lambda a, b, t=table: "[" + "".join(re.escape(c) for x in t[a - 0x80 : b - 0x80] for c in x) + "]"
        tail = one(0x80, 0xC0)
        pattern = re.compile(f"{one(0xC2, 0xE0)}{tail}|{one(0xE0, 0xF0)}{tail}{{2}}|{one(0xF0, 0xF5)}{tail}{{3}}")
        out.append((name, pattern, {c: b for b, x in enumerate(table, 0x80) for c in x}))
    return out


def _believable(c: str, encoding: str) -> bool:
    """Whether a decoded character is one that texts have, rather than an accident of neighbouring characters."""
    o = ord(c)
    if o < 0x180 or c == "ƒ":
        return o >= 0xA0 or o < 0x80 or encoding in ("cp1252", "iso8859-15")  # a control character may be a nested layer
    if o < 0x800:
        return (0x400 <= o < 0x460 or 0x386 <= o < 0x3CF or 0x2C6 <= o <= 0x2DD) and encoding in ("cp1252", "iso8859-15", "cp1251", "cp1254")
    return 0x2010 <= o < 0x2800 or 0x3000 <= o < 0xA000 or 0xFB00 <= o < 0xFB07 or o in (0xFEFF, 0xFFFD) or 0x1D400 <= o < 0x1D800 or 0x1F000 <= o < 0x1FB00


_BOX = re.compile(r"^[─-▟]+$")
#: All sequences of all readers stand in these.
_RUN = re.compile("[^\x00-\x7f]{2,}")
_POINTS = "«»“”„‘’–—…€•\u00a0\u202f"


def _accident(text: str, m: re.Match, new: str, alone: bool) -> bool:
    """Whether a sequence is more likely a letter with the punctuation after it: « café », allé…”, „Ä“."""
    before, run = text[max(0, m.start() - 1) : m.start()], m.group()
    if 0x3000 <= ord(new[0]) < 0xA000:
        return alone and (before.isalpha() or all(c in _POINTS for c in run[1:]))
    return run[0] == "Ä" and (before.isupper() and run[1] in "…“”»\u00a0" or before != "" and before in _OPEN + "„" and run[1] in _SHUT + "“…\u00a0")


def _readings(text: str) -> list[tuple[str, int]]:
    """For each encoding UTF-8 may have been read as: the text with its sequences undone, and their characters."""
    out = []
    runs = "\n".join(_RUN.findall(text))
    for name, pattern, back in _readers():
        if not runs or not pattern.search(runs):
            continue
        done, last = 0, -1

        def swap(m: re.Match, name=name, back=back, pattern=pattern) -> str:
            nonlocal done, last
            run = m.group()
            try:
                new = bytes(back[c] for c in run).decode("utf-8")
            except UnicodeDecodeError:
                return run
            if not all(_believable(c, name) for c in new):
                return run
            if _BOX.match(run) and (_BOX.match(text[max(0, m.start() - 1) : m.start()]) or _BOX.match(text[m.end() : m.end() + 1])):
                return run  # part of drawn lines
            if _accident(text, m, new, last != m.start() and not pattern.match(text, m.end())):
                return run
            done, last = done + len(run), m.end()
            return new

        new = pattern.sub(swap, text)
        if done:
            out.append((new, done))
    return out


def layer_cost(text: str, readings: list[tuple[str, int]]) -> float:
    """Garbling cost of a text with its readings: that of its words, and of the characters that read as UTF-8."""
    return cost(text) + SEQUENCE * max((n for _, n in readings), default=0)


def _unlayer(text: str) -> tuple[str, int]:
    """Text with its layers of UTF-8 read as a legacy encoding undone, and their number.

    Of the readings of a layer that cost less than the text as it is, the one is taken that undoes the most characters, of
    several the one of least cost. As the cost falls with every layer, this ends.
    """
    layers, readings = 0, _readings(text)
    here = layer_cost(text, readings) if readings else 0.0
    while True:
        tried = [(done, new, _readings(new)) for new, done in readings]
        better = [(-done, there, i) for i, (done, new, again) in enumerate(tried) if (there := layer_cost(new, again)) < here]
        if not better:
            return text, layers
        _, here, i = min(better)
        text, readings, layers = tried[i][1], tried[i][2], layers + 1


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha() or c in _LOWER or c in _UPPER


def word_cost(word: str) -> float:
    """How unlikely the characters of a word are where they stand."""
    return _short_cost(word) if len(word) <= 40 else _word_cost(word)


def _word_cost(word: str) -> float:
    total = 0.0
    for i, c in enumerate(word):
        if c < "\x80":
            continue
        before, after = word[i - 1 : i] if i else "", word[i + 1 : i + 2]
        by_letter = (before != "" and _letter(before)) or (after != "" and _letter(after))
        if c in _LOWER:
            total += 1.0 if after.isascii() and after.isupper() and not before.isupper() else 0.0
        elif c in _UPPER:
            total += 2.0 if before != "" and before.islower() else 0.0
        elif c in _OPEN or c in _SHUT or c in "’":
            if c == "’" or c == "‘":
                total += 0.0
            elif c not in _SHUT:
                total += 2.0 if before != "" and before.isalpha() else 0.0
            elif c not in _OPEN:
                total += 2.0 if after != "" and after.isalpha() else 0.0
            else:
                total += 2.0 if before.isalpha() and after.isalpha() else 0.0
        elif c in "ºª":
            total += 0.0 if before != "" and before.isalnum() else 1.0
        elif c in "€–—…•□■½¼¾":
            total += 2.0 if (before.isalpha() and after.isalpha()) or (c in "½¼¾" and by_letter) else 1.0 if after.isalpha() and c in "–—" and before == "" else 0.0
        elif c in _MARKS or 0x2500 <= ord(c) < 0x25A0:
            total += 2.0 if by_letter else 1.0 if c in "‡¯ˆ´¸¬╗╝╚╔½" else 0.0
        elif c in _PLAIN:
            total += 2.0 if before.isalpha() and after.isalpha() else 0.0
        elif 0x80 <= ord(c) < 0xA0 or c == "�":
            total += 3.0
        elif 0x370 <= ord(c) < 0x530:
            latin = (before.isalpha() and ord(before) < 0x250) or (after.isalpha() and ord(after) < 0x250)
            total += 2.0 if latin else 0.8 if not (before.isalpha() or after.isalpha()) and c in "аЂЋјЅ" else 0.0
        elif c.isalpha() and ord(c) < 0x250:
            total += 2.0 if c.isupper() and before != "" and before.islower() else 0.5
    return total


_short_cost = lru_cache(1 << 16)(_word_cost)
_JOIN = re.compile(r"([^\W\d_]*)([–—…])(?=([^\W\d_]*))")
_VOWEL = re.compile("[aeiouyàâäæèéêëîïôöœùûüÿáíóúý]", re.I)


def shown_cost(word: str) -> float:
    """Cost without dashes and dots that may join or begin words (dit—elle): those are no evidence unless a mere rest of a word follows (canci—n, ma–ana)."""

    def plain(m: re.Match) -> str:
        a, c, b = m.groups()
        rest = len(a) > 1 and _VOWEL.search(a) and b.islower() and not _VOWEL.search(b)
        tilde = c == "–" and a and a[-1] in "aeiou" and b[:1] in ("a", "e", "i", "o", "u") and len(b) <= 3
        return m.group() if rest or tilde else a + "-"

    return word_cost(_JOIN.sub(plain, word))


_WORD = re.compile(r"[^\s]*[^\x00-\x7f\s][^\s]*")
_SENTENCE = re.compile(r"[^\n.!?]*[\n.!?]?")


def cost(text: str) -> float:
    """Garbling cost: the sum over the words with characters beyond ASCII."""
    return sum(map(word_cost, _WORD.findall(text)))


def _reread(text: str, read: str, written: str) -> str | None:
    """The characters beyond ASCII taken back to bytes and strictly decoded; None where that fails."""
    out = []
    for c in text:
        if c < "\x80":
            out.append(c)
            continue
        try:
            out.append(c.encode(read).decode(written))
        except UnicodeError:
            if ord(c) < 0x100 and read != "latin-1":  # a byte the encoding lacks stays a control character
                try:
                    out.append(bytes([ord(c)]).decode(written))
                    continue
                except UnicodeDecodeError:
                    return None
            return None
    return "".join(out)


def _changed(before: str, after: str) -> list[tuple[str, str]]:
    """Words that differ between two texts of one length."""
    return [(m.group(), after[m.start() : m.end()]) for m in _WORD.finditer(before) if after[m.start() : m.end()] != m.group()] if len(before) == len(after) else []


def _unconfuse(text: str) -> tuple[str, float]:
    """Text with sentences reread under the pair of encodings that lowers the cost most, and the drop; at least half of DROP must be shown."""
    parts = [x for x in _SENTENCE.findall(text) if x]
    costs = [cost(x) if not x.isascii() else 0.0 for x in parts]
    if not any(costs):
        return text, 0.0
    best, most, pair = text, 0.0, None
    for read, written in CONFUSED:
        drop, shown, new = 0.0, 0.0, []
        for part, before in zip(parts, costs, strict=True):
            if before:
                again = _reread(part, read, written)
                if again is None or any(word_cost(x) > word_cost(w) for w, x in _changed(part, again)):  # perhaps a mixed sentence: word by word
                    single = _WORD.sub(lambda m: x if (x := _reread(m.group(), read, written)) is not None and word_cost(x) < word_cost(m.group()) else m.group(), part)
                    again = single if again is None or cost(single) < cost(again) - DROP / 4 else again
                after = cost(again)
                if after < before:
                    shown += sum(max(0.0, shown_cost(w) - word_cost(x)) for w, x in _changed(part, again))
                    drop, part = drop + before - after, again
            new.append(part)
        if drop > most + 1e-9 and shown >= DROP / 2:
            best, most, pair = "".join(new), drop, (read, written)
    if pair:  # sentences that cost nothing as they are, in a line whose others were garbled
        lines = list(zip(text.split("\n"), best.split("\n"), strict=True))
        whole = [_reread(old, *pair) if old != new else None for old, new in lines]
        best = "\n".join(w if w is not None and cost(w) <= cost(new) else new for (_, new), w in zip(lines, whole, strict=True))
    return best, most


_UNLATIN = re.compile(r"[^\W\d_\x00-\x7f]{4,}")
_FOREIGN = re.compile("[^\x00-\x7f]{4,}")
# Fixed value: letters that are rare in Russian, each under two in a hundred.
_RARE = "бгжзйфхцчшщъэюБГЖЗЙФХЦЧШЩЪЭЮ"
_CYRILLIC, _GREEK, _LATIN = re.compile("[\u0400-\u045f]"), re.compile("[\u0386-\u03ce]"), re.compile("[\u00aa\u00b5\u00ba\u00c0-\u024f]")
_KANA, _HAN = re.compile("[\u3041-\u30fe]"), re.compile("[\u4e00-\u9fa5]")


def script_cost(line: str) -> float:
    """How unlikely the scripts of a line are: Latin words without a plain letter, capitals inside words, rare letters,
    control characters and signs in runs."""
    total = 0.0
    for run in _FOREIGN.findall(line):
        letters = sum(c.isalpha() for c in run)
        total += 0.5 * (len(run) - letters) + 3.0 * sum("\x80" <= c < "\xa0" for c in run)
        for word in _UNLATIN.findall(run):
            if _LATIN.match(word):
                total += 0.5 * len(word)
            elif _CYRILLIC.match(word):
                total += sum(0.5 for c in word if c in _RARE) + sum(1.0 for c, d in zip(word, word[1:], strict=False) if c.islower() and d.isupper()) + sum(1.0 for c in word if not "а" <= c.lower() <= "ё")
            elif _GREEK.match(word):
                total += sum(1.0 for c, d in zip(word, word[1:], strict=False) if c.islower() and d.isupper())
            elif not _KANA.search(line):
                total += 0.2 * len(word)  # Chinese characters without kana come more easily by chance
    return total


def _other_script(line: str) -> tuple[str, float]:
    """A line reread under the pair of encodings that lowers its cost most, and the drop. What comes out must be letters
    of the script, all but a few; a line without four characters beyond ASCII in a row can't have them."""
    best, most = line, 0.0
    before = script_cost(line)
    if before < DROP:
        return best, most
    for read, written in SCRIPTS:
        try:
            new = line.encode(read).decode(written)
        except UnicodeError:
            continue
        beyond = [c for c in new if c > "\x7f"]
        own = _CYRILLIC if written in ("cp1251", "koi8-r", "cp866") else _GREEK if written == "cp1253" else None
        right = sum(1 for c in beyond if (own.match(c) if own else _KANA.match(c) or _HAN.match(c) or c in "、。「」・ー"))
        if len(beyond) < 4 or right < 0.9 * len(beyond):
            continue
        drop = before - script_cost(new)
        if drop > most + 1e-9:
            best, most = new, drop
    return best, most


def _unscript(text: str) -> tuple[str, float]:
    """Text with lines of another script reread, and the sum of the drops."""
    if not _FOREIGN.search(text):
        return text, 0.0
    total, out = 0.0, []
    for line in text.split("\n"):
        if _FOREIGN.search(line) and 2 * max((n for _, n in _readings(line)), default=0) < sum(c > "\x7f" for c in line):  # else it is UTF-8
            new, drop = _other_script(line)
            if drop >= DROP:
                line, total = new, total + drop
        out.append(line)
    return "\n".join(out), total


#: What a lost byte leaves behind of a sequence: its first character alone, or the first two of three.
_LOST = re.compile(r"â€|(?<![\w'’\"])[ÃÂ](?=\s|$|\d)|(?<![A-ZÀ-Þ])Ã(?=[\sa-z])|(?<=[a-z])[ÃÂ](?=[\s,.;:!?]|$)|(?<=[a-zA-Z])√(?=[a-zA-Z])")


def repair(text: str) -> tuple[str, int, float, bool]:
    """The text as far as it can be restored, layers undone, drop of the cost of rereading, whether characters are lost."""
    text, drop = _unscript(text)
    text, layers = _unlayer(text)
    lost = "\ufffd" in text or bool(_LOST.search(text))
    if layers and lost:
        text = re.sub(r"(?<![\w'’\"])Ã(?=\s)", "à", text)  # the second byte was a no-break space, since made a plain one
    for step in (_unscript, _unconfuse) if layers else (_unconfuse,):
        new, fell = step(text)
        if fell >= DROP:
            text, drop = new, drop + fell
    return text, layers, drop, lost or (not layers and bool(re.search("[\x80-\x84\x86-\x9f]", text)))


def repaired(records: DataFrame, id_column: str = "id", text_column: str = "content") -> DataFrame:
    """id, content (restored where possible), layers, drop, lost of the records that were decoded wrongly.

    Null, empty and correct texts have no row; repeated rows stay, a null id stays null, other columns are ignored. Every
    text beyond ASCII is tried; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in slices(b.column(1)):
                found = []
                for i, t in enumerate(b.column(1).slice(low, high - low).to_pylist(), low):
                    if t.isascii():
                        continue
                    new, layers, drop, lost = repair(t)
                    if layers or lost or drop >= DROP:
                        found.append((i, new, layers, drop, lost))
                at, text, layers, drop, lost = zip(*found, strict=True) if found else ((), (), (), (), ())
                arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(text, pa.string()), pa.array(layers, pa.int32()), pa.array(drop, pa.float64()), pa.array(lost, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "content", "layers", "drop", "lost"])

    rows = records.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("content")).where("length(content) > 0")
    return spread(rows).mapInArrow(run, "id long, content string, layers int, drop double, lost boolean")


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/lexical_index.parquet"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_repaired(spark, sf_dir).select("id").distinct()
