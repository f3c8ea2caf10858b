"""Titles of records: repair of damaged text, words, and what tells publications apart."""

from __future__ import annotations

import html
import re
import unicodedata

#: Placeholders and notes that some feeds put around titles.
NO_TITLE = {"", "untitled", "untitled document", "n a", "na", "no title", "none", "null", "unknown", "tba"}
NOTES = re.compile(r"\[(pdf|html|epub|online)\]|\.pdf\s*$|\|\s*(download|pdf|full text)\b.*$|--\s*(accepted|submitted|author'?s?) (version|manuscript|copy)\b.*$", re.I | re.S)
#: Kinds of text that are publications of their own beside the full one.
OWN_KINDS = re.compile(r"[\(\[]\s*(extended abstract|abstract|poster|preprint|demo|erratum|correction|reply|comment|abridged)\s*[\)\]]", re.I)
_PART = re.compile(r"[,:(\s]+(?:part|pt\.?|vol(?:ume)?\.?|no\.?)\s+(\d+|[ivx]+|one|two|three|four|five|six|seven|eight|nine|ten)\b", re.I)
_NUMBERS = {w: str(k) for k, w in enumerate("one two three four five six seven eight nine ten".split(), 1)} | {w: str(k) for k, w in enumerate("i ii iii iv v vi vii viii ix x".split(), 1)}
FILLER = {"a", "an", "the", "of", "on", "in", "for", "with", "and", "under", "to", "by", "approach"}


class _Bare(dict):
    """For str.translate: drops combining signs, keeps all else; filled as characters come up."""

    def __missing__(self, code: int) -> int | None:
        self[code] = kept = None if unicodedata.combining(chr(code)) else code
        return kept


_BARE = _Bare()
_WORD = re.compile(r"[\w�]+\.?")
_TAG, _DOUBLE, _BROKEN = re.compile(r"</?\w+>"), re.compile(r"[Â-ô][\x80-¿]+"), re.compile(r"(?<=\w)- +(?=\w)")


def _decode(m: re.Match) -> str:
    try:
        return m[0].encode("latin-1").decode("utf-8")
    except UnicodeError:
        return m[0]


def repair(text: str) -> str:
    """Entities, tags, doubled encoding and signs set right; lost letters stay as U+FFFD."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _DOUBLE.sub(_decode, text)
        text = unicodedata.normalize("NFKD", text.replace("&", "and").replace("_", " ").replace("\xad", "").replace("…", "...")).translate(_BARE)
    else:
        text = text.replace("&", "and").replace("_", " ")
    return (_BROKEN.sub("", text) if "- " in text else text).lower()


def split_title(title: str | None) -> tuple[list[str], str, bool]:
    """Words, the mark of the publication beside its words (parts, numbers, own kinds), and whether the end is cut off."""
    if not title:
        return [], "", False
    kinds = sorted(m[1].lower() for m in OWN_KINDS.finditer(title))
    text = NOTES.sub(" ", OWN_KINDS.sub(" ", title))
    text = repair(text).strip()
    cut = text.endswith("...")
    marks = [f"part{_NUMBERS.get(m[1], m[1])}" for m in _PART.finditer(text)]
    text = _PART.sub(" ", text)
    words = _WORD.findall(text)
    numbers = [w for w in words if w.removesuffix(".").isdecimal()]
    if numbers:
        marks += [w.rstrip(".") for w in numbers]
        words = [w for w in words if not w.removesuffix(".").isdecimal()]
    if words and not cut:
        words[-1] = words[-1].rstrip(".")
    words = [w for k, w in enumerate(words) if k == 0 or w != words[k - 1]]
    if " ".join(w.rstrip(".") for w in words) in NO_TITLE:
        return [], "", False
    return words, " ".join(sorted(marks) + kinds), cut


def gram_text(words: list[str]) -> str:
    """The letters that n-grams are taken of; a lost letter counts as e."""
    return " ".join(w.rstrip(".") for w in words).replace("�", "e")


def grams(words: list[str], n: int = 3) -> set[str]:
    """Letter n-grams over the words' letters."""
    text = gram_text(words)
    return {text[k : k + n] for k in range(max(1, len(text) - n + 1))} if text else set()


def edits(a: str, b: str, most: int = 2) -> int:
    """Letters put in, left out or replaced, or neighbours swapped, between a and b; most + 1 if more. A lost letter fits any."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # equal ends cost nothing; cells farther than most from the diagonal can't come back within it
    first, end_a, end_b = 0, len(a), len(b)
    while first < end_a and first < end_b and a[first] == b[first]:
        first += 1
    while end_a > first and end_b > first and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[first:end_a], b[first:end_b]
    n, over = len(b), most + 1
    before, row = None, [min(j, over) for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        new = [over] * (n + 1)
        new[0] = best = min(i, over)
        for j in range(max(1, i - most), min(n, i + most) + 1):
            y = b[j - 1]
            cost = row[j - 1] if x == y or x == "�" or y == "�" else row[j - 1] + 1
            if row[j] < cost:
                cost = row[j] + 1
            if new[j - 1] < cost:
                cost = new[j - 1] + 1
            if before is not None and j > 1 and before[j - 2] < cost and x == b[j - 2] and a[i - 2] == y:
                cost = before[j - 2] + 1
            if cost < over:
                new[j] = cost
                if cost < best:
                    best = cost
        if best > most:
            return over
        before, row = row, new
    return row[-1]


def _like(x: str, y: str) -> bool:
    """One word typed in two ways: few slips, or an abbreviation with a full stop."""
    if x.endswith(".") or y.endswith("."):
        short, long = sorted((x.rstrip("."), y.rstrip(".")), key=len)
        if len(short) >= 3 and long.startswith(short):
            return True
        if len(short) >= 3 and long[0] == short[0] and edits(short, long[: len(short)], 1) <= 1:
            return True
    x, y = x.rstrip("."), y.rstrip(".")
    if min(len(x), len(y)) < 4:
        return x == y or (len(x) == len(y) == 3 and edits(x, y, 1) <= 1)
    return edits(x, y, 2) <= (1 if min(len(x), len(y)) < 6 else 2)


def _shortened(x: str, y: str) -> bool:
    """One word shortened without a full stop, as Nets for Networks; for titles that abbreviate other words."""
    short, long = sorted((x.rstrip("."), y.rstrip(".")), key=len)
    return len(short) >= 4 and short.endswith("s") and long.startswith(short[:-1])


def compare_words(a: list[str], b: list[str]) -> tuple[str, int]:
    """same: each word has its counterpart; less: one title lacks words, cut: one ends early; other: a word differs. And the number of content words without counterpart."""
    rest_b = list(b)
    abbreviated = any(w.endswith(".") for w in (*a, *b))
    rest_a = []
    for w in a:
        if w in rest_b:
            rest_b.remove(w)
        else:
            rest_a.append(w)
    left = []
    for w in rest_a:
        hit = next((v for v in rest_b if _like(w, v) or (abbreviated and _shortened(w, v))), None)
        if hit is None:
            left.append(w)
        else:
            rest_b.remove(hit)
    left = [w for w in left if w not in FILLER]
    right = [w for w in rest_b if w not in FILLER]
    if not left and not right:
        return "same", 0
    if left and right:
        if edits("".join(left).replace(".", ""), "".join(right).replace(".", ""), 2) <= 2:
            return "same", 0
        # a word cut off: all that one title has is the beginning of the other
        ja, jb = "".join(a).replace(".", ""), "".join(b).replace(".", "")
        short, long, n = (ja, jb, len(right)) if len(ja) < len(jb) else (jb, ja, len(left))
        if len(short) >= 10 and edits(short, long[: len(short)], 2) <= 2:
            return "cut", n
        if len(left) == 1 or len(right) == 1:
            one, many = (left[0], right) if len(left) == 1 else (right[0], left)
            if one == (a if one in a else b)[-1] and any(v.startswith(one) for v in many):
                return "cut", len(many)
        return "other", max(len(left), len(right))
    many, short, long = (left, b, a) if left else (right, a, b)
    if "".join(long).replace(".", "").startswith("".join(short).replace(".", "")):
        return "cut", len(many)
    return "less", len(many)
