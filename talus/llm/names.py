"""Taking apart the names of payees: who is named, in which trade, under which number."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Short forms of given names.
NICKNAMES = {
    "AL": "ALEXANDER", "ALEX": "ALEXANDER", "SANDY": "ALEXANDER", "TONY": "ANTHONY", "BARB": "BARBARA", "BABS": "BARBARA", "BEN": "BENJAMIN", "BENNY": "BENJAMIN", "CHARLIE": "CHARLES", "CHUCK": "CHARLES",
    "CINDY": "CYNTHIA", "DAN": "DANIEL", "DANNY": "DANIEL", "DEB": "DEBORAH", "DEBBIE": "DEBORAH", "DEBRA": "DEBORAH", "LOLA": "DOLORES", "ED": "EDWARD", "EDDIE": "EDWARD", "TED": "EDWARD", "NED": "EDWARD",
    "BETH": "ELIZABETH", "BETTY": "ELIZABETH", "LIZ": "ELIZABETH", "ELIZA": "ELIZABETH", "LIBBY": "ELIZABETH", "FRANK": "FRANCISCO", "PACO": "FRANCISCO", "PANCHO": "FRANCISCO", "GREG": "GREGORY", "LUPE": "GUADALUPE",
    "LUPITA": "GUADALUPE", "NACHO": "IGNACIO", "JIM": "JAMES", "JIMMY": "JAMES", "JAMIE": "JAMES", "JEN": "JENNIFER", "JENNY": "JENNIFER", "JACK": "JOHN", "JOHNNY": "JOHN", "JOE": "JOSEPH", "JOEY": "JOSEPH", "PEPE": "JOSEPH",
    "KATE": "KATHERINE", "KATHY": "KATHERINE", "KATIE": "KATHERINE", "KAY": "KATHERINE", "LARRY": "LAWRENCE", "MEG": "MARGARET", "PEGGY": "MARGARET", "MAGGIE": "MARGARET", "MARGE": "MARGARET", "MATT": "MATTHEW", "MIKE": "MICHAEL",
    "MICKEY": "MICHAEL", "NICK": "NICHOLAS", "PAT": "PATRICIA", "TRISH": "PATRICIA", "PATTY": "PATRICIA", "TRICIA": "PATRICIA", "PHIL": "PHILIP", "RAY": "RAYMOND", "BECKY": "REBECCA", "BECCA": "REBECCA", "DICK": "RICHARD",
    "RICH": "RICHARD", "RICK": "RICHARD", "BOB": "ROBERT", "BOBBY": "ROBERT", "ROB": "ROBERT", "SAM": "SAMUEL", "SAMMY": "SAMUEL", "STEVE": "STEVEN", "STEPHEN": "STEVEN", "SUE": "SUSAN", "SUSIE": "SUSAN", "TERRY": "THERESA",
    "TESS": "THERESA", "TESSA": "THERESA", "TERESA": "THERESA", "TOM": "THOMAS", "TOMMY": "THOMAS", "TIM": "TIMOTHY", "TIMMY": "TIMOTHY", "VICKY": "VICTORIA", "VICKI": "VICTORIA", "TORI": "VICTORIA", "VIC": "VICTORIA", "VINCE": "VINCENT", "VINNIE": "VINCENT",
    "BILL": "WILLIAM", "BILLY": "WILLIAM", "WILL": "WILLIAM", "LIAM": "WILLIAM", "ALEJANDRO": "ALEXANDER", "ANDY": "ANDREW", "DAVE": "DAVID", "CHRIS": "CHRISTOPHER", "MARY": "MARIA", "LINDA": "LINDA", "NANCY": "NANCY", "KAREN": "KAREN",
}
# Legal forms and what they are short for.
LEGAL = {
    "INC": "INC", "INCORPORATED": "INC", "INCORP": "INC", "LLC": "LLC", "CO": "CO", "COMPANY": "CO", "CORP": "CORP", "CORPORATION": "CORP", "LTD": "LTD", "LIMITED": "LTD", "PLLC": "PLLC", "PLC": "PLLC", "LP": "LP", "LLP": "LLP", "PC": "PC",
}
TITLES = {"MR", "MRS", "MS", "DR", "MISS", "PROF", "REV"}
# Name keys that name nobody.
PLACEHOLDERS = {
    "", "NULL", "UNKNOWN", "NOT AVAILABLE", "NOT APPLICABLE", "CONFIDENTIAL PAYEE", "CONFIDENTIAL", "NAME WITHHELD", "VARIOUS EMPLOYEES", "VARIOUS", "MISC PAYEE", "MISCELLANEOUS PAYEE", "MISCELLANEOUS", "REDACTED", "NONE", "N/A", "NA",
}

def fold(key: str) -> str:
    """Upper case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", key.upper()) if not unicodedata.combining(c))


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours as one, within a band; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [most + 1] * len(b)
        low, high = max(1, i - most), min(len(b), i + most)
        best = most + 1
        for j in range(low, high + 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, older[j - 2] + 1)
            row[j] = v
            best = min(best, v)
        if best > most:
            return most + 1
    return min(row[len(b)], most + 1)


def _shortens(short: str, word: str) -> bool:
    """A clipped word or one without some of its letters: begins alike, letters in order, clearly shorter."""
    if not short or short[0] != word[0] or len(short) >= len(word):
        return False
    if word.startswith(short):
        return True
    stem, plural = (short[:-1], True) if short.endswith("S") and not word.endswith("S") else (short, False)
    rest = iter(word)
    return len(stem) >= 2 and (len(stem) <= max(4, len(word) // 2) or not plural and len(stem) <= len(word) - 2) and all(c in rest for c in stem)


def _clean(key: str) -> str:
    text = fold(key)
    text = re.sub(r"\([^)]*\)?", " ", text)
    text = re.sub(r"\s(?:ATTN|DBA|D/B/A|C/O)\b.*$", " ", text)
    text = re.sub(r"\s[-–]\s*[A-Z]+$", " ", text)
    text = re.sub(r"[.'’`]", "", text)
    text = re.sub(r"#|\b(?:NO|NUM|NR|NUMBER)\b(?=\W*\d)", " ", text)
    return re.sub(r"\s+", " ", re.sub(r"[^A-Z0-9, ]", " ", text)).strip()


def _legal(tokens: list[str]) -> tuple[list[str], str]:
    """The tokens without a legal form at their end, and the form."""
    joined = " ".join(tokens)
    for long, form in (("LIMITED LIABILITY COMPANY", "LLC"), ("LIMITED LIABILITY CO", "LLC"), ("L L C", "LLC"), ("P L L C", "PLLC"), ("P L C", "PLLC")):
        if joined.endswith(" " + long):
            return joined[: -len(long)].split(), form
    if len(tokens) > 1 and tokens[-1] in LEGAL:
        return tokens[:-1], LEGAL[tokens[-1]]
    return tokens, ""


class Lexicon:
    """What tells namesakes apart: the trades of firms and kinds of districts (as full phrases), given names and their short forms."""

    def __init__(self, phrases: list[str], given: list[str], nicknames: dict[str, str] = NICKNAMES):
        self.phrases, self.nicknames = sorted(phrases), nicknames
        self.words = sorted({w for t in phrases for w in t.split()})
        self.given = {g for g in given if g not in nicknames} | set(nicknames.values())
        self.given_in_order = sorted(self.given)
        self.trade_words, self.trades, self.given_name = (lru_cache(maxsize=1 << 16)(f) for f in (self._trade_words, self._trades, self._given_name))

    def __reduce__(self):
        return Lexicon, (self.phrases, self.given_in_order, self.nicknames)

    def _trade_words(self, token: str) -> dict[str, int]:
        """The trade words that a token may stand for: 0 as written, 1 with a typing error, 2 clipped, 3 with letters left out."""
        out = {}
        for w in self.words:
            if token == w:
                out[w] = 0
            elif len(token) >= 4 and distance(token, w, 2 if len(w) >= 8 else 1) <= (2 if len(w) >= 8 else 1):
                out[w] = 1
            elif _shortens(token, w):
                out[w] = 2 if w.startswith(token) else 3
        return out

    def _trades(self, tokens: tuple[str, ...]) -> tuple[str, ...]:
        """The trades that the tokens may name, best explained only: every token stands for a word of the trade, in order."""
        found: list[tuple[int, int, str]] = []
        for t in self.phrases:
            words, at, cost = t.split(), 0, 0
            if words[0] not in self.trade_words(tokens[0]):
                continue
            for token in tokens:
                kinds = self.trade_words(token)
                while at < len(words) and words[at] not in kinds:
                    at += 1
                if at == len(words):
                    break
                cost += kinds[words[at]]
                at += 1
            else:
                found.append((cost, len(words) - len(tokens), t))
        least = min((cost for cost, _, _ in found), default=0)
        best = [(missing, t) for cost, missing, t in found if cost == least]
        if least < 2:  # a word written out is of the trade that has it; a clipped one may be of any
            best = [x for x in best if x[0] == min(best)[0]]
        return tuple(sorted(t for _, t in best))

    def _given_name(self, token: str) -> str | None:
        """The full given name that a token stands for, also with one typing error."""
        if token in self.given:
            return token
        if token in self.nicknames:
            return self.nicknames[token]
        if len(token) >= 5:
            near = [g for g in self.given_in_order if len(g) >= 5 and distance(token, g, 1) <= 1]
            near = near or [g for g in self.given_in_order if len(g) >= 7 and distance(token, g, 2) <= 2]
            if len(near) == 1:
                return near[0]
        return None

    def _person(self, surname: str, rest: list[str]) -> dict | None:
        rest = [t for t in rest if t not in TITLES]
        if not rest or len(rest) > 2 or len(surname) < 3:
            return None
        first, middle = rest[0], rest[1] if len(rest) > 1 else ""
        if len(middle) > 1:
            return None
        if len(first) == 1:
            return {"kind": "person", "core": surname, "other": "", "attr": "", "cands": [first], "num": middle, "legal": ""}
        name = self.given_name(first)
        return name and {"kind": "person", "core": surname, "other": "", "attr": name, "cands": [name], "num": middle, "legal": ""}

    def parse(self, key: str) -> dict | None:
        """What a name key says: kind, core (the name itself, without blanks), other (its words in the other order),
        attr (trade or given name if it is certain), cands (what it may be), num (number or middle initial), legal form.
        None for placeholders and keys without letters."""
        if key in PLACEHOLDERS:
            return None
        text = _clean(key)
        if text in PLACEHOLDERS or not re.search("[A-Z]{2}", text):
            return None
        head, _, tail = text.partition(",")
        head, tail = head.split(), tail.replace(",", " ").split()
        if head[:1] == ["THE"]:
            head = head[1:]
        if tail:
            if len(head) == 1 and (found := self._person(head[0], tail)):
                return found
            tokens = tail + head if all(self.trade_words(t) for t in head) else head + tail
            if tokens[: len(tail)] == tail and len(tail) > 1:  # the legal form and the number stay last
                body, form = _legal(tail)
                digits = [t for t in body if t.isdigit()]
                tokens = [t for t in body if not t.isdigit()] + head + digits + ([form] if form else [])
        else:
            tokens = head
            if 2 <= len([t for t in tokens if t not in TITLES]) <= 3:
                plain = [t for t in tokens if t not in TITLES]
                if len(plain[0]) > 2 and (found := self._person(plain[0], plain[1:])) and (self.given_name(plain[0]) is None or self.given_name(plain[-1]) is not None or len(plain[-1]) == 1 and len(plain) == 3 and self.given_name(plain[1])):
                    return found
                if all(len(t) == 1 for t in plain[:-1]) and len(plain[-1]) > 4 and (found := self._person(plain[-1], plain[:-1])):
                    return found
                if self.given_name(plain[0]) and len(plain[-1]) > 2 and (found := self._person(plain[-1], plain[:-1])):
                    return found
        tokens = [t for t in tokens if t != "AND"]
        tokens, form = _legal(tokens)
        number = "".join(t for t in tokens if t.isdigit())
        tokens = [t for t in tokens if not t.isdigit()]
        if not tokens:
            return None
        split = next((i for i, t in enumerate(tokens) if i and (i >= 2 or self.trade_words(t))), len(tokens))
        if split == 2 and len(tokens) > 2 and not self.trade_words(tokens[2]) and len(tokens[2]) > 3:
            split = next((i for i, t in enumerate(tokens) if i > 2 and self.trade_words(t)), len(tokens))
        if split == 1 and len(tokens) > 1 and len(tokens[1]) == 1:
            split = 1
        core, named = tokens[:split], tuple(tokens[split:])
        found = self.trades(named) if named else ()
        if named and not found and any(f.startswith(named[-1]) for f in LEGAL):  # a legal form cut off
            core, named = core, named[:-1]
            found = self.trades(named) if named else ()
        if named and not found:
            core, named = tokens, ()
        return {
            "kind": "firm", "core": "".join(core), "other": "".join(core[1:] + core[:1]) if len(core) > 1 else "", "attr": found[0] if len(found) == 1 else "", "cands": list(found), "num": number, "legal": form,
        }


def evidence(key: str) -> list[tuple[str, str]]:
    """What a key tells about the words in use: ("given", a name behind a comma and a surname) or ("phrase", each run of at most four words at its end)."""
    if key in PLACEHOLDERS:
        return []
    head, _, tail = _clean(key).partition(",")
    tokens, behind = [t for t in head.split() if t not in ("THE", "AND")], [t for t in tail.replace(",", " ").split() if t not in TITLES]
    if behind:
        plain = len(tokens) == 1 and len(behind[0]) > 1 and (len(behind) == 1 or len(behind) == 2 and len(behind[1]) == 1)
        return [("given", behind[0])] if plain else []
    tokens = [t for t in _legal(tokens)[0] if not t.isdigit()]
    tokens = [t for t in _legal(tokens)[0] if len(t) > 1]
    return [("phrase", " ".join(tokens[-n:])) for n in range(1, min(4, len(tokens) - 1) + 1)]


def lexicon_of(counts: dict[tuple[str, str], int], nicknames: dict[str, str] = NICKNAMES) -> Lexicon:
    """The lexicon that the frequent evidence gives.

    Of the phrases those remain that aren't mostly the end of longer frequent
    ones, and that no more frequent phrase explains as its clipped, misspelt or
    shortened form; given names, which stand at the end too, are no trades.
    """
    given = {w for kind, w in counts if kind == "given"} | set(nicknames) | set(nicknames.values())
    ends = {w: n for (kind, w), n in counts.items() if kind == "phrase" and not set(w.split()) & given}
    longer = {w: sum(n for x, n in ends.items() if x.endswith(" " + w) and x.count(" ") == w.count(" ") + 1) for w in ends}
    kept: list[str] = []
    ends_of = lambda phrase: [" ".join(phrase.split()[i:]) for i in range(len(phrase.split()))]
    for w in sorted((w for w, n in ends.items() if longer[w] < 0.7 * n), key=lambda w: (-ends[w], w)):
        if not kept or not Lexicon([e for k in kept for e in ends_of(k)], [], {}).trades(tuple(w.split())):
            kept.append(w)
    return Lexicon(kept, sorted(w for kind, w in counts if kind == "given"), nicknames)
