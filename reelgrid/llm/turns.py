"""Transcript segments into ordered speaker turns of spoken words.

Times and sound notes are taken out by their shape. Wherever a speaker is named, at the seam of two
segments or inside one, a turn may begin: gradient-boosted trees decide it from the label's form, the
gap between the segments, how the one before ended and what follows. A second such model tells
hesitation sounds from words by their letters and neighbours, token by token, so it also knows sounds
that nobody listed. Both are trained here from small labelled tables that the functions below write
out from patterns; their labels depend on gap and context where the label's form leaves it open.

A seam without a label never begins a turn, whatever its gap: such text goes on with the speaker before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.boost import Boosted
from reelgrid.llm.canonical import canonical
from reelgrid.llm.names import fold

# How roles are written (without accents, points or repeated blanks) and their labels.
ROLES = {
    "mc": "MC", "nguoi dan": "MC", "nguoi dan chuong trinh": "MC", "dan chuong trinh": "MC", "bien tap vien dan": "MC", "presenter": "MC", "host": "MC", "anchor": "MC",
    "pv": "PV", "phong vien": "PV", "reporter": "PV",
    "khach": "KHACH", "khach moi": "KHACH", "guest": "KHACH",
}
# Hesitation sounds of the labelled table, with repeated letters written once.
HESITATIONS = ["à", "ờ", "ơ", "ừ", "ừm", "ưm", "ờm", "ơm", "hừm", "hưm", "hm", "um", "uh", "uhm", "er", "erm", "ah", "eh", "ùm", "ậm", "ừa"]
# Words of sound notes, without accents.
SOUNDS = ["nhac", "nhac nen", "vo tay", "cuoi", "tieng cuoi", "tieng mua", "tieng coi xe", "im lang", "music", "applause", "laughter", "laughs", "silence", "noise", "tieng on", "ho", "tieng ho", "khoc", "tieng khoc", "cheering", "crosstalk", "inaudible", "khong nghe ro", "tieng gio", "tieng chuong", "tieng vo tay", "tieng nhac"]

_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_LONG_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?"
TIMES = re.compile(rf"{_CLOCK}\s*-->\s*{_CLOCK}|[\[(<{{]\s*{_CLOCK}(?:\s*(?:-|–|-->)\s*{_CLOCK})?\s*[\])>}}]|(?<!\S){_LONG_CLOCK}(?!\S)")
_SIGNED_SOUNDS = re.compile(r"♪[^♪\n]*♪|[♪♫]+|(?<!\S)\*[^*\n]+\*")
_BRACKETS = re.compile(r"\[([^\[\]]*)\]|<([^<>]*)>|\(([^()]*)\)|\{([^{}]*)\}")
_NAMES = r"(?:m\.?\s?c\.?|p\.?\s?v\.?|ng[uư][oờ]i\s+d[aẫ]n(?:\s+ch[uư][oơ]ng\s+tr[iì]nh)?|d[aẫ]n\s+ch[uư][oơ]ng\s+tr[iì]nh|ph[oó]ng\s+vi[eê]n|kh[aá]ch(?:\s+m[oờ]i)?|presenter|host|anchor|reporter|guest|(?:speaker|spk|ng[uư][oờ]i\s+n[oó]i|s)[\s_#-]*\d{1,3})"
PLACES = re.compile(rf"(?P<arrow>(?:>>|»)\s*)?(?P<open>[\[(<{{]\s*)?(?<![^\W_])(?P<name>{_NAMES})(?![^\W_])(?P<close>\s*[\])>}}])?(?P<sep>\s*[:：]|\s+[-–—](?=\s|$))?", re.IGNORECASE)


def speaker_of(name: str) -> str | None:
    """The label of a speaker's name, however it is written."""
    f = " ".join(fold(name).replace(".", "").split())
    f = {"m c": "mc", "p v": "pv"}.get(f, f)
    if f in ROLES:
        return ROLES[f]
    n = re.fullmatch(r"(?:speaker|spk|nguoi noi|s)[\s_#-]*(\d{1,3})", f)
    return f"S{int(n[1])}" if n else None


def without_times_and_sounds(text: str) -> str:
    """The text without times and sound notes; other asides in round brackets stay."""
    text = _SIGNED_SOUNDS.sub(" ", TIMES.sub(" ", text))

    def bracket(m: re.Match) -> str:
        inner = next(g for g in m.groups() if g is not None)
        f = " ".join(fold(inner).split())
        if speaker_of(inner):
            return m.group()
        if f in SOUNDS or not f:
            return " "
        # Square, angle and curly brackets hold notes about the sound; round ones what was said aside.
        return m.group() if m.group()[0] == "(" else " "

    return _BRACKETS.sub(bracket, text)


BOUNDARY_FEATURES = ["arrow", "bracket", "round", "colon", "dash", "at start", "after sentence", "numbered", "capitals", "capital first", "next is capital", "gap", "same speaker", "abbreviated"]
#: Seconds of gap beyond which more says nothing.
LONG_GAP = 10.0


def boundary_features(m: re.Match, text: str, gap: float, ended: bool, before: str | None) -> list[float]:
    """What the boundary model sees of one place that names a speaker.

    ``gap`` and ``ended``: seconds since the segment before, and whether that ended a sentence; they
    count at the start of a segment. ``before``: the speaker of the label before.
    """
    left, name, right = text[: m.start()].rstrip(), m["name"], text[m.end() :].lstrip()
    opened = (m["open"] or "").strip() if m["close"] else ""
    sep = (m["sep"] or "").strip()
    return [
        bool(m["arrow"]), opened in ("[", "<", "{") and bool(opened), opened == "(", sep in (":", "："), sep in ("-", "–", "—") and bool(sep), not left, left.endswith((".", "!", "?", "…")) if left else ended,
        name[-1].isdigit(), name.isupper(), name[:1].isupper(), right[:1].isupper(), min(gap, LONG_GAP) if not left else 0.0, speaker_of(name) == before, sum(c.isalpha() for c in name) <= 3,
    ]


_MARKS = "\u0300\u0301\u0309\u0303\u0323\u031b\u0302\u0306"


def token_features(token: str, before: str = "", first: bool = False) -> list[float]:
    """What the hesitation model sees of one token: its letters and accents, how it is drawn out, and the token before it."""
    core = re.sub(r"^\W+|\W+$", "", token.lower())
    once = re.sub(r"(.)\1+", r"\1", core)
    d = unicodedata.normalize("NFD", once.replace("đ", "d"))
    base = "".join(c for c in d if not unicodedata.combining(c))
    drawn = max((len(r.group()) for r in re.finditer(r"(.)\1*", core)), default=0)
    return [
        len(base), drawn, len(core) - len(once), base.count("m"), base.count("h"), base.count("r"), base.count("n"), sum(c in "aeiouy" for c in base), sum(c not in "aeiouymhr" for c in base),
        "a" in base, "e" in base, "i" in base, "o" in base, "u" in base, *(k in d for k in _MARKS), base[:1] in "aeiouy", base[:1] == "h", base[:1] == "m", base[-1:] == "m", base[-1:] == "h", base[-1:] in "aeiouy",
        core.isascii(), any(c.isdigit() for c in core), token.endswith(("...", "…")), token.endswith(","), token.endswith("?"), any(c.isdigit() for c in before), before.endswith((".", ",", "…", "?", "!")), first,
    ]


def labelled_boundaries(rows: int = 2400, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table of boundaries: labels in many styles, bare ones that gap and context make a label or a word, and mentions in sentences."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    roles = ["MC", "M.C.", "Người dẫn", "Nguoi dan", "NGƯỜI DẪN CHƯƠNG TRÌNH", "PV", "P.V.", "pv", "mc", "p.v.", "Phóng viên", "Phong vien", "Khách", "Khách mời", "KHÁCH MỜI", "Khach moi", "mc", "Reporter", "Guest"]
    numbered = ["S{}", "Speaker {}", "SPEAKER_{:02d}", "spk{}", "Người nói {}", "NGƯỜI NÓI {:02d}", "speaker{}"]
    bare = ["MC", "PV", "M.C.", "P.V.", "KHÁCH MỜI", "PHÓNG VIÊN", "Speaker {}", "SPEAKER_{:02d}", "S{}", "NGƯỜI DẪN"]
    said = ["bữa trưa đã dọn xong", "Chúng tôi đang ở bến xe.", "gió thổi khá mạnh", "Mọi người vừa tới nơi.", "we are at the station", "12 chiếc ghế xếp thành hàng", "Phần 4: một bài hát", "Xin chào quý vị!", "Vâng, tôi nghe rõ"]
    begins = ["Chúng tôi bắt đầu nhé", "Xin chào quý vị!", "Vâng, tôi nghe rõ", "Cảm ơn anh.", "Hôm nay có gì mới?", "Tôi xin trả lời"]
    talk = ["có chừng 20 {} ngồi đợi", "một {} giơ tay hỏi", "cùng {} đi thăm xưởng", "anh {} ghé quán từ sớm", "{} tới muộn vì kẹt xe", "nghe {} kể lại", "chỗ của {} ở hàng đầu", "các {} đã vào phòng, đèn tắt", "nhóm {} trở lại sau", "mời {} dùng trà"]
    lower = ["khách", "khách mời", "phóng viên", "người dẫn chương trình", "Khách", "Phóng viên", "người dẫn", "Người dẫn", "mc", "S7", "s 3", "MC", "PV"]
    x, y = [], []
    while len(y) < rows:
        gap, ended = float(rng.exponential(1.5)), bool(rng.random() < 0.5)
        before, kind = pick(["MC", "PV", "KHACH", "S1", "S2", None]), rng.random()
        if kind < 0.5:  # a separator or brackets make a label, wherever it stands
            name = pick(roles) if rng.random() < 0.5 else pick(numbered).format(int(rng.integers(1, 10)))
            style = pick(["{}:", "{} :", "{} -", "[{}]", "<{}>", "({}):"])
            text, want = pick(["", "", pick(said) + " "]) + pick(["", ">> "]) + style.format(name) + " " + pick(said), 1
        elif kind < 0.72:  # without them a mention in a sentence is no label
            text, want = pick(talk).format(pick(lower)), 0
            if rng.random() < 0.3:
                text = text + pick([", nhưng", ". Rồi", " - và"]) + " " + pick(said)
            if rng.random() < 0.5:
                text = text[0].upper() + text[1:]
        elif kind < 0.9:  # a bare label at the start: who speaks after a gap and a finished sentence, or a name the sentence goes on with
            text = pick(bare).format(int(rng.integers(1, 10))) + " " + pick(begins if rng.random() < 0.75 else said)
            right = text.split(" ", 2 if text[:2] in ("KH", "PH", "NG", "Sp") else 1)[-1]
            gap = float(rng.uniform(0, 4))
            want = int(gap >= 1.2 and ended and right[:1].isupper())
        else:  # a small word and a dash: a label where a sentence begins, an aside inside one
            inside = rng.random() < 0.6
            arrow = rng.random() < 0.3  # which names a speaker wherever it stands
            text = (pick(["đó là", "có một nhóm", "mời các"]) + " " if inside else pick(["Mọi người vừa tới nơi. ", ""])) + (">> " if arrow else "") + pick(["khách", "khách mời", "phóng viên", "người dẫn"]) + " - " + pick(said)
            want = int(arrow or not inside)
        for m in PLACES.finditer(text):
            x.append(boundary_features(m, text, gap, ended, before))
            y.append(want)
    return np.array(x, float), np.array(y, float)


# Common short words, many of them like a hesitation sound but for a letter or an accent.
WORDS = "ở ô ôi ông ối ồ ổ anh em u ủ mưa mùa màu mm m hồ hoa hơn hờ ra về ừng ạ ả á a an ơn ướm nhờ nhà mà thì là 12 8 ha he ho km ăn ấm êm hè hẻm hóm hẹn mở mờ mơ mẹ má thơ lờ lớ bờ cờ phở hum ham him the I are her over under out or our home me my ư ứ ý y uy ai áo ao eo âm ẩm ám om ôm im ơi ời ừa ưa ưu ớt ức ấy này kia đó đây có không và với cho của một hai ba bốn năm người việc làm đi đến nói hỏi đáp nghe thấy biết hiểu cần phải được bị rất quá lắm nữa rồi sẽ đang đã vẫn cứ chỉ cũng đều mọi những các trên dưới trong ngoài trước sau giữa bên cạnh nếu nhưng vì nên để khi lúc nào sao gì thế vậy dạ vâng chị bác cô chú cháu mình tôi ta họ nó hm2 ah1".split()


def labelled_tokens(seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table of tokens: hesitation sounds drawn out and punctuated, and words, in their places.

    Drawn-out murmurs of m and h are made by rule. One or two m after a number are a unit.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    x, y = [], []

    def add(token: str, before: str, want: int) -> None:
        x.append(token_features(token, before, not before))
        y.append(want)

    befores = ["", "ngày", "đó.", "này,", "tôi", "the", "thì", "12"]
    murmurs = [f"{a}{'m' * int(rng.integers(1, 5))}" for a in ("ư", "ừ", "ơ", "ờ", "ử", "ửh", "hử", "hừ", "hư", "ừh", "ưh", "uh", "ah", "eh") for _ in range(3)] + ["mmm", "mmmm", "hmmmm", "mhm", "mmhm", "ờờờ", "ơơ", "àààà", "uhhh", "errr", "ehh", "ahh"]
    for h in [h for h in HESITATIONS for _ in range(4)] + murmurs:
        for _ in range(5):
            t = h[:-1] + h[-1] * int(rng.integers(1, 4))
            t = (t.capitalize() if rng.random() < 0.3 else t) + pick(["", "", "...", ",", ".", "…"])
            add(t, pick(befores), 1)
    for w in WORDS:
        for end in ("", "", ",", ".", "...", "?"):
            add((w.capitalize() if rng.random() < 0.2 else w) + end, pick(befores), 0)
    # Syllables that begin with a sound of their own, and numbers, also with a figure repeated.
    onsets, vowels, codas = "b c ch d đ g gi k kh l n ng nh ph qu r r s t th tr v x m m h h".split(), "a ă â e ê i o ô ơ u ư ươ iê uô oa ua ia".split(), ["", "", "c", "i", "m", "m", "n", "ng", "nh", "p", "t", "u"]
    for _ in range(900):
        onset, vowel, coda = pick(onsets), pick(vowels), pick(codas)
        if onset == "h" and (len(vowel) == 1 and coda in ("", "m", "n") or not coda):
            continue  # hừ, hơm, hứn: too like a murmur to say
        w = unicodedata.normalize("NFC", onset + vowel + pick(["", "\u0300", "\u0301", "\u0309", "\u0303", "\u0323"]) + coda)
        if rng.random() < 0.2:
            w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).replace("đ", "d")
        add((w.capitalize() if rng.random() < 0.2 else w) + pick(["", "", ",", ".", "...", "?"]), pick(befores), 0)
    for _ in range(200):
        n = str(int(rng.integers(0, 700))) + pick(["", "", ",", ".", ":", f",{int(rng.integers(0, 9))}"])
        add(n * 2 if len(n) == 1 else n, pick(befores), 0)
    for n in ("11", "22", "33", "55", "155", "22,2", "111", "00"):
        add(n, "là", 0)
    for unit in ("m", "mm", "m,", "mm.", "M"):
        for n in ("12", "3,5", "146"):
            add(unit, n, 0)
    return np.array(x, float), np.array(y, float)


@lru_cache(maxsize=1)
def models() -> tuple[Boosted, Boosted]:
    """The two trained models: boundaries and hesitations."""
    return Boosted(trees=60, depth=4).fit(*labelled_boundaries()), Boosted(trees=60, depth=5).fit(*labelled_tokens())


class TurnMaker:
    """Applies the two models; a token's decision is remembered with what was seen of its neighbours."""

    def __init__(self, boundary: Boosted, hesitation: Boosted):
        self.boundary, self.hesitation = boundary, hesitation
        self.words: dict[tuple, bool] = {}

    def spoken(self, parts: list[list[str]]) -> list[list[str]]:
        """The tokens that are words, of each part."""
        keyed = []
        for tokens in parts:
            tokens = [t for t in tokens if any(c.isalnum() for c in t)]
            # All that the model sees of the token before: a digit, an ending sign, or that there is none.
            before = ["", *((("1" if any(c.isdigit() for c in t) else "a") + (t[-1] if t[-1] in ".,…?!" else "")) for t in tokens[:-1])]
            keyed.append(list(zip(tokens, before)))
        new = list({k for ks in keyed for k in ks if k not in self.words})
        if new:
            if len(self.words) > 200_000:
                self.words.clear()
                new = list({k for ks in keyed for k in ks})
            p = self.hesitation.probability(np.array([token_features(t, b, not b) for t, b in new], float))
            self.words.update(zip(new, (p < 0.5).tolist()))
        return [[t for t, b in ks if self.words[t, b]] for ks in keyed]

    def turns(self, segments: list[dict | None]) -> list[tuple[str, float | None, float | None, list[str]]]:
        """(speaker, start, end, words) of each turn, in order."""
        rows, seen = [], set()
        for s in segments:
            if not s or not s["text"] or not s["text"].strip():
                continue
            key = (s["start"], s["text"])
            if key not in seen:
                seen.add(key)
                rows.append(s)
        far = float("inf")
        rows.sort(key=lambda s: far if s["start"] is None or s["start"] != s["start"] else s["start"])
        # All possible boundaries of the transcript are decided at once.
        places, features, end, closed, named = [], [], None, True, None
        texts = [without_times_and_sounds(canonical(s["text"])) for s in rows]
        for s, text in zip(rows, texts):
            start = s["start"] if s["start"] == s["start"] else None
            gap = max(0.0, start - end) if end is not None and start is not None else LONG_GAP
            found = [m for m in PLACES.finditer(text) if speaker_of(m["name"])]
            for m in found:
                features.append(boundary_features(m, text, gap, closed, named))
                if m["sep"] or m["close"]:
                    named = speaker_of(m["name"])
            places.append(found)
            if text.strip():
                closed = text.rstrip().endswith((".", "!", "?", "…"))
            if start is not None:
                end = start + (s["duration"] or 0.0)
        yes = iter((self.boundary.probability(np.array(features, float)) >= 0.5).tolist() if features else [])
        parts: list[tuple[str, str, dict]] = []  # who, what, in which segment
        speaker = "UNK"
        for s, text, found in zip(rows, texts, places):
            at = 0
            for m in found:
                if next(yes):
                    parts.append((speaker, text[at : m.start()], s))
                    speaker, at = speaker_of(m["name"]), m.end()
            parts.append((speaker, text[at:], s))
        out: list[tuple[str, float | None, float | None, list[str]]] = []
        for (who, _, s), words in zip(parts, self.spoken([p.split() for _, p, _ in parts])):
            if not words:
                continue
            end = s["start"] + (s["duration"] or 0.0) if s["start"] is not None else None
            if out and out[-1][0] == who:
                out[-1][3].extend(words)
                out[-1] = (who, out[-1][1], end, out[-1][3])
            else:
                out.append((who, s["start"], end, words))
        return out


def speaker_turns(df: DataFrame, key: str, segments: str) -> DataFrame:
    """(key, turn_no, speaker, start_sec, end_sec, n_words, words): the turns of each transcript.

    Speakers: MC, PV, KHACH, S1, S2, ..., or UNK before the first label. Text without a label goes on
    with the speaker before. Turns without words are dropped and neighbours of one speaker joined.

    Defined cases: null or empty segment lists and null or blank texts give no turns; a segment with
    the start and text of another counts once; null starts come last, in their order; equal starts keep
    their order; repeated rows give repeated turns, which a distinct() removes; other columns are not read.
    """
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{segments}`").alias("segments"))
    boundary, hesitation = models()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = TurnMaker(boundary, hesitation)
        for b in batches:
            keys, lists = b.column(0), b.column(1)
            for i in range(0, b.num_rows, 50):
                got = [(k, n, *t) for k, s in zip(keys.slice(i, 50).to_pylist(), lists.slice(i, 50).to_pylist()) for n, t in enumerate(maker.turns(s or []), 1)]
                if got:
                    k, n, who, a, z, words = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(k, keys.type), pa.array(n, pa.int32()), pa.array(who, pa.string()), pa.array(a, pa.float64()), pa.array(z, pa.float64()), pa.array([len(w) for w in words], pa.int32()), pa.array([" ".join(w) for w in words], pa.string())], ["key", "turn_no", "speaker", "start_sec", "end_sec", "n_words", "words"])

    kind = df.schema[key].dataType.simpleString()
    made = src.mapInArrow(run, f"key {kind}, turn_no int, speaker string, start_sec double, end_sec double, n_words int, words string")
    return made.withColumnRenamed("key", key)
