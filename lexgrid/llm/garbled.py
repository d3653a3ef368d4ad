"""Garbled text from wrong character encodings.

Noisy-channel decoding. A channel is a pair (the encoding a text was in, the encoding it was read with), possibly applied
twice. Each white-space separated stretch with a non-ASCII sign is taken back to bytes under every channel. The bytes of a stretch are a lattice:
signs that were lost (U+FFFD) are wildcards in it, edges that stand for every sign of the corpus that fits there, in UTF-8 and in encodings of one byte
a sign alike, and each way through it is a reading. A Viterbi search over the stretches of a
text chooses between leaving them as they are and decoding them by a channel; a reading's score is the probability of
its words under the word frequencies of the whole corpus, and changing the channel has a price.

Readings are made and scored once for each different stretch, not for each text. The counts of the words they need are joined to them; no task
and no driver holds the words of the corpus, only the frequencies of its signs. Only texts with a stretch that some channel explains better go to the search.

Frequencies are counted over all texts; what is known does not
depend on the corpus size. A text is no witness for itself: of its own words one occurrence is not counted, so a word that stands
there alone is unknown as it stands and known as a reading. `least` is the probability that all unknown words have together.

Defined results: null, empty and ASCII texts are never garbled; U+FFFD and C1 controls (but NEL) are always garbled, restored or
not; white space stays as it is; escapes of correct text (entities, \\u00e9) are ASCII and left alone; repeated texts are judged alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread

#: A word: one sign of a script without spaces, a run of other letters, or one other non-ASCII sign. For Java and for Python.
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
JAVA_WORD = rf"[{_CJK}]|[\p{{L}}\p{{M}}&&[^{_CJK}]]+|[^\x00-\x7F]"
WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+|[^\x00-\x7F]", regex.V1)
LOST = "�"
CONTROLS = re.compile("[\x80-\x84\x86-\x9f]")

#: Encodings that texts are read with by mistake, and encodings they are in.
READ_AS = ["cp1252", "cp1250", "cp1251", "cp1254", "cp1253", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15", "gbk", "cp932", "big5"]
WRITTEN_IN = ["utf_8", "cp1252", "cp1250", "cp1251", "cp1254", "cp1258", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "cp932", "euc_jp", "gbk", "big5", "euc_kr"]
WIDE = {"gbk", "cp932", "big5", "euc_jp", "euc_kr"}
TWICE = ["cp1252", "cp1250", "cp437", "mac_roman"]
#: Rows of one word and its count: some 20 MB.
BROADCAST_ROWS = 250_000
#: Log prices: to enter a channel, to change to another one, to come back.
ENTER, CHANGE, LEAVE = 9.0, 11.0, 0.5


def _back(name: str) -> dict[int, int | str]:
    """From the signs of a one-byte encoding to its bytes; bytes without a sign stand for the control of their number."""
    table: dict[int, int | str] = {c: "Ā" for c in range(128, 256)}
    signs = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(128, 256)]
    for b, s in reversed(list(enumerate(signs, 128))):
        table[ord(s)] = b
    for b in range(128, 160):
        table.setdefault(b, b)
        if table[b] == "Ā":
            table[b] = b
    return table


_TABLES = {w: _back(w) for w in READ_AS if w not in WIDE}
MARK = "\x00"  # stands for a lost byte


def to_bytes(text: str, read_as: str) -> bytes | None:
    """The bytes that were read; a lost sign is a zero byte. None if the encoding has no such sign."""
    if MARK in text:
        return None
    try:
        if read_as in WIDE:
            return MARK.encode().join(part.encode(read_as) for part in text.split(LOST))
        return text.replace(LOST, MARK).translate(_TABLES[read_as]).encode("latin-1")
    except UnicodeEncodeError:
        return None


#: One sign of two bytes or more in UTF-8, its bytes written as signs of the same number.
MULTI = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
CUT = re.compile("[\xe2-\xef][\x80-\xbf](?![\x80-\xbf])")


def _partly_wide(text: str, read_as: str) -> str:
    """The same for encodings of two bytes a sign: each run of non-ASCII signs by itself."""

    def right(m: re.Match) -> str:
        try:
            return m.group().encode(read_as).decode()
        except UnicodeError:
            return m.group()

    return re.sub("[\u0370-\uffff]+", right, text)


def _partly(text: str, read_as: str) -> str:
    """Puts right the parts of a text that are UTF-8 read with a one-byte encoding; signs of no such part stay."""
    if read_as in WIDE:
        return _partly_wide(text, read_as)
    return _put_right(text, text.translate(_TABLES[read_as]))


def _put_right(text: str, signs: str) -> str:
    """The same for a text and its bytes, written as signs of the same number."""
    out, last = [], 0
    for m in MULTI.finditer(signs):
        try:
            sign = m.group().encode("latin-1").decode()
        except UnicodeDecodeError:
            continue
        out += [text[last : m.start()], sign]
        last = m.end()
    return "".join(out) + text[last:] if last else text


#: Ways through a lattice that are kept, and signs that a wildcard may stand for.
WAYS, FITS = 16, 12


class Signs:
    """The non-ASCII signs of the corpus with their frequencies: no more than Unicode has."""

    def __init__(self, signs: dict[str, int]):
        self.signs, self.total = signs, sum(signs.values()) or 1
        self.by_bytes: dict[bytes, list[str]] = {}
        self.by_encoding: dict[tuple[str, str], list[str]] = {}

    def fitting(self, part: bytes) -> list[str]:
        """The most frequent signs whose UTF-8 bytes are those of part, zero bytes being unknown."""
        found = self.by_bytes.get(part)
        if found is None:
            pattern = re.compile(b"".join(b"[\x80-\xff]" if x == 0 else re.escape(bytes([x])) for x in part), re.S)
            fits = [c for c in self.signs if pattern.fullmatch(c.encode())]
            found = self.by_bytes[part] = sorted(fits, key=lambda c: (-self.signs[c], c))[:FITS]
        return found

    def unreadable(self, written: str, read_as: str) -> list[str]:
        """The most frequent signs of one encoding whose byte the other one has no sign for; none if it has one for every byte."""
        found = self.by_encoding.get((written, read_as))
        if found is None:
            gaps = set() if read_as in WIDE else {b for b in range(128, 256) if not bytes([b]).decode(read_as, "ignore")}
            fits = [c for c in self.signs if len(e := c.encode(written, "ignore")) == 1 and e[0] in gaps]
            found = self.by_encoding[written, read_as] = sorted(fits, key=lambda c: (-self.signs[c], c))[:FITS]
        return found

    def _walk(self, raw: bytes, edges) -> list[str]:
        """The likeliest ways through a lattice; edges(i) gives (signs, next place) from a place on."""
        at: dict[int, list[tuple[float, str]]] = {0: [(0.0, "")]}
        for i in range(len(raw)):
            ways = sorted(at.pop(i, ()), reverse=True)[:WAYS]
            for signs, j in edges(i) if ways else ():
                weighed = [(math.log(self.signs.get(c, 1) / self.total) if len(signs) > 1 else 0.0, c) for c in signs]
                at.setdefault(j, []).extend((w + v, t + c) for w, t in ways for v, c in weighed)
        return [t for _, t in sorted(at.get(len(raw), ()), reverse=True)[:WAYS]]

    def utf8(self, raw: bytes) -> list[str]:
        def edges(i: int):
            b = raw[i]
            for size in (1,) if 0 < b < 0x80 else (2,) if 0xC2 <= b < 0xE0 else (3,) if 0xE0 <= b < 0xF0 else (4,) if 0xF0 <= b < 0xF5 else (2, 3) if b == 0 else ():
                part = raw[i : i + size]
                if len(part) < size or any(x and not 0x80 <= x < 0xC0 for x in part[1:]):
                    continue
                if 0 in part:
                    yield self.fitting(part), i + size
                else:
                    try:
                        yield [part.decode()], i + size
                    except UnicodeDecodeError:
                        pass

        return self._walk(raw, edges)

    def one_byte(self, raw: bytes, written: str, read_as: str) -> list[str]:
        def edges(i: int):
            yield self.unreadable(written, read_as) if raw[i] == 0 else [raw[i : i + 1].decode(written)], i + 1

        try:
            return self._walk(raw, edges) if self.unreadable(written, read_as) else []
        except UnicodeDecodeError:
            return []

    def cut(self, text: str, read_as: str) -> list[str]:
        """Fills in signs of three bytes whose last one was dropped without a trace."""
        if read_as in WIDE or not CUT.search(signs := text.translate(_TABLES[read_as])):
            return []
        ways, last = [""], 0
        for m in CUT.finditer(signs):
            fits = self.fitting(m.group().encode("latin-1") + b"\0")
            if fits:
                ways = [w + text[last : m.start()] + c for w in ways for c in fits[:4]][:WAYS]
                last = m.end()
        return [w + text[last:] for w in ways]

    def readings(self, key: str) -> dict[str, list[int]]:
        """What a stretch may have been, each with its channels (places in CHANNELS). A channel that leaves it as it is has the stretch itself."""
        out: dict[str, list[int]] = {}
        lost = LOST in key

        def add(channel: str, reads: Iterable[str]) -> None:
            for read in reads:
                if not CONTROLS.search(read):
                    out.setdefault(read, []).append(PLACE[channel])

        parts: dict[str, str] = {}
        for read_as in READ_AS:
            if read_as in WIDE:
                raw, part = to_bytes(key, read_as), key if lost else _partly_wide(key, read_as)
            else:
                signs = key.replace(LOST, MARK).translate(_TABLES[read_as])
                try:
                    raw = None if MARK in key else signs.encode("latin-1")
                except UnicodeEncodeError:  # a sign that the encoding does not have
                    raw = None
                part = key if lost else _put_right(key, signs)
            parts[read_as] = part
            for written in WRITTEN_IN:
                if written == read_as:
                    continue
                channel = f"{written}|{read_as}|1"
                if written == "utf_8" and not lost and (part != key or read_as not in WIDE):
                    add(channel, [part])
                elif raw is None:
                    continue
                elif b"\0" in raw:
                    add(channel, self.utf8(raw) if written == "utf_8" else [] if written in WIDE else self.one_byte(raw, written, read_as))
                else:
                    try:
                        add(channel, [raw.decode(written)])
                    except UnicodeDecodeError:
                        pass
        for read_as in TWICE:
            part = parts[read_as]
            for times in ("2", "3"):
                if (channel := f"utf_8|{read_as}|{times}") in PLACE:
                    if part == key and not lost:
                        add(channel, [key])
                        continue
                    text = part if part != key else _again(key, read_as)
                    for _ in range(int(times) - 1):
                        text = _again(text, read_as)
                    add(channel, [] if text is None else [text])
            if not lost:
                add(f"utf_8|{read_as}|cut", [t for t in self.cut(part, read_as) if t != part])
        return out


def _again(text: str | None, read_as: str) -> str | None:
    """One turn of a text through UTF-8 read as another encoding, back."""
    if text is None:
        return None
    part = _partly(text, read_as) if LOST not in text else text
    if part != text or LOST not in text and read_as not in WIDE:
        return part
    raw = to_bytes(text, read_as)
    try:
        return None if raw is None or b"\0" in raw else raw.decode()
    except UnicodeDecodeError:
        return None


def outlines(key: str) -> list[str]:
    """The words of a stretch that have lost signs, each run of those as one."""
    return list(dict.fromkeys(re.sub(rf"{LOST}+", LOST, w) for w in LOST_WORD.findall(key) if w.strip(LOST)))


#: A word with lost signs.
LOST_WORD = re.compile(rf"[^\W\d_{LOST}]*(?:{LOST}+[^\W\d_{LOST}]*)+")


def filled(key: str, words: dict[str, list[str]]) -> list[str]:
    """A stretch with its lost signs filled in by known words of their outlines; nothing if one has none. A lost sign that stands alone may be any."""
    ways, last = [""], 0
    for m in LOST_WORD.finditer(key):
        fits = words.get(re.sub(rf"{LOST}+", LOST, m.group()), ())
        ways = [w + key[last : m.start()] + f for w in ways for f in fits][:WAYS]
        last = m.end()
    return [w + key[last:] for w in ways]


class Scorer:
    """Log probabilities of words, for one stretch with the counts that it needs."""

    def __init__(self, signs: Signs, total: int, least: float, first: bool):
        self.signs, self.total, self.rare, self.first = signs, math.log(total or 1), math.log(least) - 1, first
        self.unseen: dict[str, float] = {}

    def _spelled(self, word: str) -> float:
        """A word the corpus hardly has: its letters one by one, and a price for mixing alphabets."""
        known = self.unseen.get(word)
        if known is None:
            letters = sum(-3.0 if c < "\x80" else max(-14.0, math.log(self.signs.signs.get(c, 1e-9) / self.signs.total)) for c in word)
            alphabets = len({unicodedata.name(c, "?").split()[0] for c in word if c.isalpha()})
            known = self.rare + letters - 10.0 * max(0, alphabets - 1)
            if len(self.unseen) > 100_000:
                self.unseen.clear()
            self.unseen[word] = known
        return known

    def word(self, word: str, n: int) -> float:
        """Never less than if its letters alone were known."""
        if n < 1:
            return self._spelled(word)
        p = math.log(n) - self.total
        return p if p > self.rare else max(p, self._spelled(word))

    def _undoubted(self, key: str, read: str, read_as: str) -> bool:
        """Whether a stretch is UTF-8 from end to end, of signs that the corpus has."""
        try:
            (to_bytes(key, read_as) or b"\xff").decode()
        except UnicodeDecodeError:
            return False
        return LOST not in key and all(c in self.signs.signs for c in read if c > "\x7f")

    def gains(self, key: str, readings: dict[str, list[int]], counts: dict[str, int]) -> dict[int, tuple[float, str]]:
        """By channel what its best reading gains over the stretch as it is, and that reading; readings far worse are left out."""
        of = lambda text, own: [self.word(w, counts.get(w, 0) - own) for w in dict.fromkeys(WORD.findall(text))]
        own_words = of(key, 1)
        own, rarest = sum(own_words), min(own_words, default=0.0)
        out: dict[int, tuple[float, str]] = {}
        for read, channels in readings.items():
            if read == key:
                for c in channels:
                    out[c] = max(out.get(c, (0.0, key)), (0.0, key))
                continue
            words = of(read, 0)
            base, least = sum(words) - own, min(words, default=0.0)
            strange = any(counts.get(w, 0) < 1 for w in WORD.findall(read) if not w.isascii())
            for c in channels:
                name, gain = CHANNELS[c], base
                if name.endswith("cut"):
                    gain -= 4  # the sign is a guess
                if self.first and name in UNDOUBTED and self._undoubted(key, read, name.split("|")[1]):
                    gain = max(gain, SUSPECT + 1)  # the second round decides
                elif least <= rarest:
                    gain = min(gain, 0.0)  # the rarest word has to gain too, else words only ran together
                if not name.startswith("utf_8") and strange:
                    gain = min(gain, 3.0)  # words nobody else uses are weak evidence
                if gain > -12 and gain > out.get(c, (-12.0, ""))[0]:
                    out[c] = (gain, read)
        return out


def best(keys: list[str], gains: dict[str, dict[int, tuple[float, str]]], enter: float) -> list[tuple[int, int]]:
    """(place, channel) of the stretches that a channel explains better, by Viterbi search. Scores are gains over leaving all as it is."""
    at: dict[int, tuple[float, tuple | None]] = {-1: (0.0, None)}
    seen: set = set()  # what has been read already is no new evidence
    for k, key in enumerate(keys):
        clean, top = at[-1], max(at.values(), key=lambda x: x[0])
        leave = top[0] - LEAVE
        new = {-1: clean if clean[0] >= leave else (leave, top[1])}
        again = frozenset(WORD.findall(key))
        repeated = again in seen
        seen.add(again)
        for c, (gain, read) in gains.get(key, {}).items():
            if repeated:
                gain = min(gain, 0.0)
            score, trace = clean[0] - enter, clean[1]
            if top[0] - CHANGE > score:
                score, trace = top[0] - CHANGE, top[1]
            if c in at and at[c][0] > score:
                score, trace = at[c]
            new[c] = (score + gain, (k, c, trace) if read != key else trace)
        # a stretch that a channel can't read keeps nobody in it but costs no more than a way out
        for c, (score, trace) in at.items():
            if c >= 0 and c not in new:
                new[c] = (score - 1.0, trace)
        at = new
    trace, out = max(at.values(), key=lambda x: x[0])[1], []
    while trace is not None:
        k, c, trace = trace
        out.append((k, c))
    return out[::-1]


def _stretches(text: str) -> list[tuple[int, int, str]]:
    """(start, end, key) of the stretches with a sign that is not ASCII; a key has one 0 for each number."""
    return [(m.start(), m.end(), re.sub("[0-9]+", "0", m.group())) for m in re.finditer(r"[^ \t\n\r]+", text) if not m.group().isascii()]


def _numbered(read: str, text: str) -> str | None:
    """A reading of a key with the numbers of the text that it stands for; numbers are ASCII and go through every channel."""
    numbers = re.findall("[0-9]+", text)
    parts = re.split("0", read)
    return "".join(x for pair in zip(parts, [*numbers, ""]) for x in pair) if len(parts) == len(numbers) + 1 else None


def repaired(text: str, gains: dict[str, dict[int, tuple[float, str]]]) -> tuple[list[tuple], str] | None:
    """Spans (start, end, channel, restored) and the text put right; None if nothing is garbled."""
    spans = _stretches(text)
    found = {}
    for k, c in best([key for _, _, key in spans], gains, ENTER):
        a, b, key = spans[k]
        read = _numbered(gains[key][c][1], text[a:b])
        if read is not None and read != text[a:b]:
            found[a] = (a, b, CHANNELS[c], read)
    for a, b, key in spans:
        if a not in found and (LOST in key or CONTROLS.search(key)):
            found[a] = (a, b, "unknown", None)
    if not found:
        return None
    done, out, last = sorted(found.values(), key=lambda s: s[0]), [], 0
    for a, b, _, read in done:
        out += [text[last:a], text[a:b] if read is None else read]
        last = b
    return done, "".join(out) + text[last:]


#: The price in the first round.
SUSPECT = 4.0
CHANNELS = [f"{t}|{r}|1" for r in READ_AS for t in WRITTEN_IN if t != r] + [f"utf_8|{r}|2" for r in TWICE] + ["utf_8|cp1252|3", "lost"] + [f"utf_8|{r}|cut" for r in TWICE]

#: Channels whose readings are byte for byte UTF-8, which signs put together by chance hardly are.
UNDOUBTED = {c for c in CHANNELS if c.startswith("utf_8|") and not c.endswith("cut") and c.split("|")[1] not in WIDE}


PLACE = {c: i for i, c in enumerate(CHANNELS)}

#: Per stretch: channels, what each gains, the place of its reading in reads.
GAINS = "channels array<smallint>, gains array<float>, places array<smallint>, reads array<string>"


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) over all texts."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(JAVA_WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _signs(counts: DataFrame) -> Signs:
    """The signs of the words, weighed by these: no more rows than Unicode has signs."""
    foreign = counts.filter(F.col("word").rlike(r"[^\x00-\x7F]") & ~F.col("word").contains(LOST) & ~F.col("word").rlike("[\x80-\x84\x86-\x9f]"))
    letters = foreign.select(F.explode(F.split("word", "")).alias("c"), "n").filter(F.col("c").rlike(r"[^\x00-\x7F]")).groupBy("c").agg(F.sum("n").alias("n"))
    return Signs({r["c"]: r["n"] for r in letters.collect()})


def _scored(made: DataFrame, counts: DataFrame, signs: Broadcast, total: int, least: float, first: bool) -> DataFrame:
    """made(key, reads, channels, words, outlines) with the counts of its words -> (key, GAINS)."""
    few = counts.count() <= BROADCAST_ROWS
    counts = F.broadcast(counts) if few else counts
    need = made.select("key", F.explode("words").alias("word")).join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("counts"))
    plain = counts.filter(~F.col("word").contains(LOST) & F.col("word").rlike(r"[^\x00-\x7F]") & (F.col("n") > 0) & ~F.col("word").rlike("[\x80-\x84\x86-\x9f]"))
    known = plain.withColumn("outline", F.regexp_replace("word", r"[^\x00-\x7f]+", LOST)).filter(F.col("outline") != LOST)
    wanted = made.select("key", F.explode("outlines").alias("outline"))
    known = known.join(wanted.select("outline").distinct(), "outline", "left_semi")
    known = known.withColumn("_r", F.row_number().over(Window.partitionBy("outline").orderBy(F.desc("n"), "word"))).filter(F.col("_r") <= 3)
    fills = wanted.join(known, "outline").groupBy("key").agg(F.collect_list(F.struct("outline", "word", "n")).alias("fills"))
    whole = made.select("key", "reads", "channels").join(need, "key", "left").join(fills, "key", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(signs.value, total, least, first)
        for pdf in batches:
            rows = []
            for key, reads, channels, counts, fills in pdf.itertuples(index=False, name=None):
                n = {x["word"]: int(x["n"]) for x in counts} if counts is not None else {}
                readings = {r: c.tolist() for r, c in zip(reads, channels)}
                if fills is not None:
                    words: dict[str, list[str]] = {}
                    for x in sorted(fills, key=lambda x: (-x["n"], x["word"])):
                        words.setdefault(x["outline"], []).append(x["word"])
                        n[x["word"]] = int(x["n"])
                    for read in filled(key, words):
                        readings.setdefault(read, []).append(PLACE["lost"])
                found = sorted(scorer.gains(key, readings, n).items())
                place = {r: i for i, r in enumerate(dict.fromkeys(r for _, (_, r) in found))}
                rows.append((key, [c for c, _ in found], [g for _, (g, _) in found], [place[r] for _, (_, r) in found], list(place)))
            yield pd.DataFrame(rows, columns=["key", "channels", "gains", "places", "reads"])

    return spread(whole).mapInPandas(run, f"key string, {GAINS}")


def _with_gains(texts: DataFrame, keys: DataFrame, scored: DataFrame) -> DataFrame:
    """texts(k, t), keys(k, key), scored -> (k, t, found ARRAY): each text with the gains of its stretches."""
    of = keys.join(scored, "key").groupBy("k").agg(F.collect_list(F.struct("key", "channels", "gains", "places", "reads")).alias("found"))
    return texts.join(of, "k", "left")


def _gains_of(found) -> dict[str, dict[int, tuple[float, str]]]:
    return {x["key"]: {int(c): (float(g), x["reads"][i]) for c, g, i in zip(x["channels"], x["gains"], x["places"])} for x in found} if found is not None else {}


def repair(texts: DataFrame, key: str, column: str, least: float = 2e-6) -> DataFrame:
    """(key, spans ARRAY<STRUCT<start_char, end_char, channel, restored>>, restored): one row per garbled text.

    Two rounds: the first one finds texts under suspicion at a low price and takes the words of their garbled stretches
    out of the frequencies; the second one judges those texts again. A span's channel is `unknown` and its restored null
    where it is garbled but can't be read; restored is the text with all readable spans put right.
    """
    context = texts.sparkSession.sparkContext
    kind = texts.schema[key].dataType.simpleString()
    counts = materialize(word_counts(texts, column))
    total = counts.agg(F.sum("n")).first()[0] or 0
    signs = context.broadcast(_signs(counts))

    some = texts.select(F.col(key).alias("k"), F.col(column).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7F]"))
    parts = F.filter(F.split("t", r"[ \t\n\r]+"), lambda x: x.rlike(r"[^\x00-\x7F]"))
    keys = materialize(some.select("k", F.explode(F.array_distinct(F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "0")))).alias("key")))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k in pdf["key"]:
                found = signs.value.readings(k)
                words = dict.fromkeys(w for t in (k, *found) for w in WORD.findall(t))
                rows.append((k, list(found), list(found.values()), list(words), outlines(k) if LOST in k else []))
            yield pd.DataFrame(rows, columns=["key", "reads", "channels", "words", "outlines"])

    made = materialize(spread(keys.select("key").distinct()).mapInPandas(make, "key string, reads array<string>, channels array<array<int>>, words array<string>, outlines array<string>"))
    first = materialize(_scored(made, counts, signs, total, least, True))
    # a text is under suspicion only if the gains of its different stretches could pay the lower price
    hopes = first.select("key", F.greatest(F.lit(0.0), F.coalesce(F.array_max("gains"), F.lit(0.0))).alias("hope"), (F.col("key").contains(LOST) | F.col("key").rlike("[\x80-\x84\x86-\x9f]")).alias("sure"))
    hopes = hopes.filter("sure or hope > 0")
    hit = keys.join(hopes, "key").groupBy("k").agg(F.max("sure").alias("sure"), F.sum("hope").alias("hope")).filter((F.col("hope") > SUSPECT) | F.col("sure")).select("k")
    suspects = materialize(some.join(hit, "k", "left_semi"))
    theirs = materialize(keys.join(suspects.select("k"), "k", "left_semi"))

    def suspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text, found in zip(pdf["k"], pdf["t"], pdf["found"]):
                spans = _stretches(text)
                chosen = best([x for _, _, x in spans], _gains_of(found), SUSPECT)
                if chosen or LOST in text or CONTROLS.search(text):
                    rows.append((k, [w for i, _ in chosen for w in WORD.findall(text[spans[i][0] : spans[i][1]])]))
            yield pd.DataFrame(rows, columns=["k", "words"])

    held = materialize(spread(_with_gains(suspects, theirs, first)).mapInPandas(suspect, f"k {kind}, words array<string>"))
    taken = held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("m"))
    after = materialize(counts.join(taken, "word", "left").select("word", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).filter("n > 0"))
    left = suspects.join(held.select("k"), "k", "left_semi")
    theirs = materialize(theirs.join(held.select("k"), "k", "left_semi"))
    again = made.join(theirs.select("key").distinct(), "key", "left_semi")
    total = after.agg(F.sum("n")).first()[0] or 0
    second = _scored(again, after, context.broadcast(_signs(after)), total, least, False)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *done) for k, text, found in zip(pdf["k"], pdf["t"], pdf["found"]) if (done := repaired(text, _gains_of(found)))], columns=[key, "spans", "restored"])

    return spread(_with_gains(left, theirs, second)).mapInPandas(judge, f"`{key}` {kind}, spans array<struct<start_char bigint, end_char bigint, channel string, restored string>>, restored string")
