"""What a line of a statute heads, read from its left edge by a cursor over a table of words.

A reader takes a line's parts one after another (a word, a number of the level's alphabet, a dot, a footnote mark, what
follows) and says which level or region they make. Other languages or templates give another table.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Signs that open a quotation, and those that show a number to be a term of a formula.
QUOTES, OPERATORS = "“\"", "+*/=×xX"
ROMAN, LATIN = "IVXLC", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Words:
    """The words of Vietnamese statutes that open units, notes, regions and signatures."""

    part: str = "Phần"
    ordinal: str = "thứ"
    chapter: str = "Chương"
    section: str = "Mục"
    article: str = "Điều"
    clause: str = "Khoản"
    points: str = LATIN + "đ"
    both: str = "và"
    of: str = "của"
    statutes: tuple[str, ...] = ("Bộ luật", "Luật", "Nghị quyết", "Pháp lệnh")
    provides: str = "quy định như sau:"
    certified: str = "XÁC THỰC VĂN BẢN HỢP NHẤT"
    grounds: str = "có căn cứ ban hành như sau"
    appendix: str = "Phụ lục"
    table: str = "STT"
    signatures: tuple[str, ...] = ("Nơi nhận", "CHỦ TỊCH", "CHỦ NHIỆM", "TM.", "KT.", "Văn bản liên quan")
    repealed: str = "Khoản này được bãi bỏ"
    month: str = "tháng"
    year: str = "năm"


WORDS = Words()


@dataclass(frozen=True)
class Form:
    """kind of a line, with its unit's number and title and where the number ends."""

    kind: str
    number: str = ""
    title: str | None = None
    end: int = 0


class Reader:
    """A place in a line. Every method takes what it names and moves on, or stays and gives nothing."""

    def __init__(self, line: str):
        self.line, self.at = line, 0
        self.space()

    def rest(self) -> str:
        return self.line[self.at :]

    def ended(self) -> bool:
        return not self.rest().strip()

    def peek(self) -> str:
        return self.line[self.at : self.at + 1]

    def run(self, ok) -> str:
        start = self.at
        while self.at < len(self.line) and ok(self.line[self.at]):
            self.at += 1
        return self.line[start : self.at]

    def space(self) -> str:
        return self.run(str.isspace)

    def digits(self) -> str:
        return self.run(str.isdecimal)

    def sign(self, signs: str) -> str:
        c = self.peek()
        if c and c in signs:
            self.at += 1
            return c
        return ""

    def boundary(self) -> bool:
        c = self.peek()
        return not (c.isalnum() or c == "_")

    def word(self, phrase: str, exact: bool = False) -> bool:
        """The words of a phrase with any white space between them, in any case unless ``exact``."""
        back = self.at
        for k, w in enumerate(phrase.split()):
            here = self.line[self.at : self.at + len(w)] if not k or self.space() else ""
            if here != w and (exact or here.lower() != w.lower()):
                self.at = back
                return False
            self.at += len(w)
        return True

    def mark(self) -> bool:
        """A footnote mark: a number in square brackets."""
        back = self.at
        if self.sign("[") and self.digits() and self.sign("]"):
            return True
        self.at = back
        return False

    def labelled(self, phrase: str, exact: bool = False) -> bool:
        """A word and the space before its number."""
        back = self.at
        if self.word(phrase, exact) and self.space():
            return True
        self.at = back
        return False

    def article_number(self, letters: str = LATIN) -> str:
        n = self.digits()
        return n + self.sign(letters) if n else ""


def _cites(r: Reader, w: Words) -> bool:
    """One or more articles, or clauses of an article, joined by a word."""

    def listed(word: str, number) -> bool:
        if not (r.labelled(word) and number()):
            return False
        while True:
            back = r.at
            if not (r.space() and r.labelled(w.both) and r.labelled(word) and number()):
                r.at = back
                return True

    start = r.at
    either = lambda: r.article_number(LATIN + LATIN.upper())
    if listed(w.article, either):
        return True
    r.at = start
    return listed(w.clause, r.digits) and bool(r.space()) and r.labelled(w.article) and bool(either())


def _note(line: str, w: Words) -> bool:
    """A note that says how another statute, given by its articles, provides."""
    r = Reader(line)
    if r.mark():
        r.space()
        r.digits()
        r.space()
    if not (_cites(r, w) and r.space()):
        return False
    r.labelled(w.of)
    if not any(r.word(s) and r.boundary() for s in w.statutes):
        return False
    return w.provides.lower() in " ".join(r.rest().lower().split())


def _tail(line: str, w: Words) -> bool:
    """The certificate of a consolidated text, or the end of another statute's preamble."""
    r = Reader(line)
    if r.word(w.certified) and r.boundary():
        return True
    said = " ".join(line.split()).removesuffix(":").rstrip()
    if not said.lower().endswith(w.grounds.lower()):
        return False
    before = said[: len(said) - len(w.grounds)]
    return (not before or before[-1] == " ") and not any(c in ".?!" for c in before)


def _region(line: str, w: Words) -> str:
    for kind, words in (("appendix", (w.appendix,)), ("table", (w.table,)), ("signature", w.signatures)):
        for x in words:
            r = Reader(line)
            if r.word(x) and r.boundary():
                return kind
    return ""


def _named(line: str, w: Words) -> Form | None:
    """Units that a word opens: parts, chapters, sections and articles."""
    r = Reader(line)
    if r.labelled(w.part):
        start = r.at
        if r.labelled(w.ordinal) and r.run(lambda c: not c.isspace()):
            stop = r.at
            return Form("part", line[start:stop], None, stop) if r.ended() else None
        return None
    if r.labelled(w.chapter):
        number = r.run(lambda c: c.upper() in ROMAN)
        stop = r.at
        r.sign(".")
        r.mark()
        back = r.at
        if not (r.space() and r.sign("(") and r.run(lambda c: c != ")") and r.sign(")")):
            r.at = back
        return Form("chapter", number, None, stop) if number and r.ended() else None
    if r.labelled(w.section):
        number = r.digits()
        stop = r.at
        if number and r.sign(".") and r.space() and not r.ended():
            return Form("section", number, r.rest().strip(), stop)
        return None
    if r.labelled(w.article, exact=True):
        number = r.article_number()
        stop = r.at
        if number and r.sign("."):
            r.mark()
            if r.ended():
                return Form("article", number, None, stop)
            if r.space():
                return Form("article", number, r.rest().strip(), stop)
    return None


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal() and c.isalpha()


def _numbered(line: str, w: Words) -> Form | None:
    """Points and clauses; ``loose`` where the sign that should follow a clause's number is missing."""
    r = Reader(line)
    label = r.sign(w.points)
    if label and r.sign(")"):
        stop = r.at - 1
        r.mark()
        return Form("point", label, None, stop) if r.space() and not r.ended() else None
    r = Reader(line)
    quoted = bool(r.sign(QUOTES))
    number = r.digits()
    stop = r.at
    if not number:
        return None
    if r.sign("."):
        after = r.at
        marked = r.mark()
        spaced = bool(r.space())
        if not r.ended() and (spaced or (marked and not quoted)):
            return Form("clause", number, None, stop)
        if quoted:
            return None
        r.at = after
        if r.digits():  # a footnote's number run into the clause's
            if r.mark():
                r.space()
                if _letter(r.peek()):
                    return Form("clause", number, None, stop)
            return None
        if _letter(r.peek()):
            return Form("clause", number, None, stop)
        return Form("loose", number, None, stop) if r.peek() and not r.peek().isspace() else None
    return Form("loose", number, None, stop) if not quoted and r.space() and not r.ended() else None


_openers: dict[Words, tuple[str, ...]] = {}


def _opens(start: str, w: Words) -> bool:
    """Whether a lower-cased line's beginning is that of any of the words."""
    known = _openers.get(w)
    if known is None:
        phrases = (w.part, w.chapter, w.section, w.article, w.clause, w.certified, w.appendix, w.table, *w.signatures)
        known = _openers.setdefault(w, tuple(sorted({p.split()[0].lower() for p in phrases})))
    return start.startswith(known)


def line_form(line: str, words: Words = WORDS, tails: bool = True) -> Form:
    """What the line heads; kind is '' for running text. ``tails``: whether the end of another preamble is looked for."""
    start = line.lstrip()[:24].lower()
    worded = start.startswith("[") or _opens(start, words)
    if worded and _note(line, words):
        return Form("note")
    if tails and (worded or words.grounds[-3:].lower() in line.rstrip()[-24:].lower()) and _tail(line, words):
        return Form("tail")
    if not worded:
        return _numbered(line, words) or Form("")
    if region := _region(line, words):
        return Form(region)
    return _named(line, words) or _numbered(line, words) or Form("")


def is_date(line: str, words: Words = WORDS) -> bool:
    """A day at the line's beginning, in figures or with the months' word."""
    r = Reader(line)
    if not 1 <= len(r.digits()) <= 2:
        return False
    if r.sign("/"):
        if not (1 <= len(r.digits()) <= 2 and r.sign("/")):
            return False
    elif not (r.space() and r.labelled(words.month) and 1 <= len(r.digits()) <= 2 and r.space() and r.labelled(words.year)):
        return False
    return len(r.digits()) == 4 and r.boundary()


def is_formula(line: str) -> bool:
    r = Reader(line)
    if not r.digits():
        return False
    r.space()
    return bool(r.sign(OPERATORS))


def is_repealed_clause(line: str, words: Words = WORDS) -> bool:
    r = Reader(line)
    return bool(r.digits() and r.space()) and r.word(words.repealed) and r.boundary()


def cites_article(line: str, words: Words = WORDS) -> bool:
    """A line that begins like an article, in quotes or not, in any case."""
    r = Reader(line)
    r.sign(QUOTES)
    if not (r.labelled(words.article) and r.article_number(LATIN + LATIN.upper()) and r.sign(".")):
        return False
    r.mark()
    return not r.rest() or r.peek().isspace()


def has_footnote(line: str) -> bool:
    return Reader(line).mark()


def follows_plainly(line: str) -> bool:
    """A clause's number, dot, optional footnote and white space."""
    r = Reader(line)
    if not (r.digits() and r.sign(".")):
        return False
    r.mark()
    return bool(r.space())
