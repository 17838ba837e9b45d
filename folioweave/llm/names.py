"""Variant spellings of names: block by phonetic codes of sorted tokens, compare with Jaro-Winkler plus a nickname table,
cluster accepted pairs by connected components.

A name is parsed into one of five forms: a full person (given name and surname), an initial with a surname, a bare
surname or core word, an organisation or place, or an acronym. Pairs of one block are compared by form. Full names link
to each other; initials, bare words and acronyms name an entity only together with the rest of the book, so they join the
one entity they agree with, and none if there are several.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import fan_out
from folioweave.llm.components import minimum_labels
from folioweave.session import cut

# English given names with their usual short forms.
NICKNAMES = """
abigail: abby abbie gail
albert: al bert bertie
alexander: alex alec sandy sasha xander
alfred: alf alfie
andrew: andy drew
anne: annie nan nancy
anthony: tony ant
archibald: archie baldie
arthur: art artie
augustus: gus gussie augie
bartholomew: bart barty bat
benjamin: ben benny benji
caroline: carrie caro lina
catherine: cathy kate katie kitty kit
charles: charlie chuck chas chaz
charlotte: lottie lotta charlie char
christopher: chris kit topher kris
cornelius: neil corny con connie
daniel: dan danny
david: dave davy
dorothy: dot dolly dottie dora
edward: ed eddie ned ted teddy
eleanor: nell nora ellie nellie ella
elizabeth: liz lizzie beth betsy betty bess eliza lisbeth
emily: em millie emmy
florence: flo florrie flossie
frances: fanny fran frannie
francis: frank
frederick: fred freddie freddy fritz rick
gabrielle: gaby gabby elle
george: georgie
gregory: greg
gwendolen: gwen wendy gwennie
harold: harry hal
harriet: hattie harry hatty
henry: harry hal hank
isabella: bella izzy bel isa
james: jim jimmy jamie jem
jane: jenny janie
john: jack johnny
joseph: joe joey jo
josephine: jo josie josey posy
joshua: josh
katherine: kate kathy kitty kit katie kath kay
lawrence: larry laurie lawrie
leonard: len lenny leo
louisa: lou lulu
lucy: lu
margaret: maggie meg peggy madge greta daisy marge
martha: patty mattie
mary: molly polly may mamie
matthew: matt matty
michael: mike mick mickey
millicent: millie milly
nathaniel: nat nate
nicholas: nick nicky nico colin
oliver: ollie noll
oswald: ozzie oz ossie
patrick: pat paddy
penelope: penny pen nell
peter: pete
philip: phil pip
philippa: pippa pip phil
rebecca: becky becca
richard: dick rick richie ricky dickie rich
robert: rob bob robbie bobby bert robin
samuel: sam sammy
sarah: sally sadie
sophia: sophie
stephen: steve
susannah: sue susie suzy sukie
theodore: theo ted teddy
thomas: tom tommy
timothy: tim timmy
victoria: vicky tori vic
walter: walt wally
william: will bill billy willie liam
winifred: winnie freda win fred
zachariah: zach zack zak
"""

# Titles, endings and particles of persons' names.
TITLES = frozenset("mr mrs ms miss mister dr doctor prof professor sir lord lady madame madam mme captain capt colonel col major maj general gen rev revd reverend sister brother father dame count countess lieutenant lt sergeant sgt judge".split())
ENDINGS = frozenset("esq esquire phd md ma ba jr junior sr senior ii iii".split())
PARTICLES = frozenset("mac mc von van de du del della der den la le da di dos o".split())

# Usual words of organisations and places with short forms of their own, and words that carry nothing. Other
# words of this sort are learned from the names: see `common_kinds`.
KINDS = """
society: soc
company: co coy
trading: trdg
association: assn assoc ass'n
university: univ uni
observatory: obs observ
department: dept
municipal: mun munic
railway: rly rwy ry
brothers: bros
incorporated: inc
limited: ltd
cooperative: co-op coop
historical: hist
navigation: nav navig
junction: jn jct junc
mount: mt mountain mtn
fort: ft
port: pt
institute: inst
museum: mus
hospital: hosp
corporation: corp
committee: cttee
government: govt
insurance: ins
royal: ryl
office: off
union: un
guild: gld
works: wks
bridge: br
street: str
road: rd
lake: lk
river: riv
church: ch
college: coll
saint:
abbey:
cape:
"""
SIDES = {"north": "north", "south": "south", "east": "east", "west": "west", "n": "north", "s": "south", "e": "east", "w": "west", "upper": "upper", "lower": "lower", "new": "new", "old": "old", "great": "great", "little": "little"}
EMPTY = frozenset("the of and & on a at in for".split())


def _table(text: str) -> dict[str, tuple[str, ...]]:
    rows = (line.split(":") for line in text.strip().splitlines())
    return {key.strip(): tuple(rest.split()) for key, rest in rows}


GIVEN: dict[str, frozenset[str]] = {}
for _full, _shorts in _table(NICKNAMES).items():
    for _name in (_full, *_shorts):
        GIVEN[_name] = GIVEN.get(_name, frozenset()) | {_full}
FULL = frozenset(_table(NICKNAMES))
for _full in FULL:  # a name that is also somebody's short form stays itself
    GIVEN[_full] = frozenset({_full})
KIND: dict[str, str] = {}
for _full, _shorts in _table(KINDS).items():
    KIND |= dict.fromkeys((_full, *_shorts), _full)
LONG_KINDS = tuple(sorted(k for k in set(KIND.values()) if len(k) >= 5))

_OCR = str.maketrans("01356849$|", "olsebbbgsl")


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def jaro_winkler(a: str, b: str) -> float:
    """The Jaro-Winkler similarity with a prefix weight of 0.1 over at most four characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    other = [y for j, y in enumerate(b) if taken[j]]
    swaps = sum(x != y for x, y in zip(mine, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _shape(word: str) -> str:
    """A word after the usual confusions of scans, so that both readings give the same."""
    return word.replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("ii", "u").replace("ll", "u").replace("li", "u").replace("i", "l").replace("c", "e")


#: Jaro-Winkler similarity from which two words of seven letters and more are spellings of one, and below which none are.
#: Between the two, and for shorter words, of which many are alike, edits decide.
SURE, LEAST = 0.9, 0.85


@lru_cache(maxsize=200_000)
def same_word(a: str, b: str) -> bool:
    """Whether two surnames or core words are spellings of one by Jaro-Winkler, as they are or after the usual confusions
    of scans. Words of more than LONGEST letters are so only if they are equal after those."""
    if a == b:
        return True
    short = min(len(a), len(b))
    if short < 4:
        return False
    x, y = _shape(a), _shape(b)
    if x == y:
        return True
    if max(len(a), len(b)) > LONGEST or abs(len(a) - len(b)) > 3:
        return False
    near = max(jaro_winkler(a, b), jaro_winkler(x, y))
    if near < LEAST:
        return False
    if near >= SURE and short >= 7:
        return True
    most = 1 if short < 7 else 2
    return distance(a, b, most) <= most or (short >= 7 and distance(x, y, 1) <= 1)


# Groups of consonants that sound or look alike.
_SOUND = {c: k for k, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}


def phonetic(word: str) -> str:
    """The codes of a word's consonants, without its vowels; its first letter counts as any other, doubled ones twice, so
    that one wrong letter changes one code at most."""
    return "".join(filter(None, map(_SOUND.get, word)))


def block_keys(word: str) -> set[str]:
    """The phonetic code of a word and that code without each one of its symbols, so that one wrong consonant, one more
    or one less still leaves a common key. Such codes of few symbols say little, so words near them have their letters
    without each one, and those of seven letters, which may differ by two, their codes too."""
    code = phonetic(word)
    keys = {code} if len(code) > 1 else {f"={word[:6]}"}
    if len(word) > 3:
        keys.add(f"/{_shape(word)}")
        if len(code) < 5:
            keys |= {f"-{word}", *(f"-{word[:i]}{word[i + 1 :]}" for i in range(len(word)))}
    if len(code) > 3 or len(code) > 1 and len(word) > 6:
        keys |= {f"~{phonetic(_shape(word))}", *(code[:i] + code[i + 1 :] for i in range(len(code)))}
    return keys


@lru_cache(maxsize=100_000)
def roots(token: str) -> frozenset[str]:
    """The full given names that a first name may stand for: itself, those it is short for, those it begins, or the known
    one it is misspelt from. A single letter stands for nothing by itself."""
    word = token.rstrip(".")
    if len(word) < 2:
        return frozenset()
    if not token.endswith(".") and word in GIVEN:
        return GIVEN[word]
    if 2 < len(word):
        begun = frozenset(x for x in FULL if x.startswith(word) and x != word)
        if begun:
            return begun | GIVEN.get(word, frozenset())
    if word in GIVEN:
        return GIVEN[word]
    if len(word) >= 4:
        near = [(distance(word, x, 2), x) for x in GIVEN if abs(len(x) - len(word)) <= 2 and len(x) >= 4]
        best = min((d for d, _ in near), default=3)
        if best <= (1 if len(word) < 6 else 2):
            found = [x for d, x in near if d == best]
            return frozenset().union(*(GIVEN[x] for x in found))
        shaped = _shape(word)
        found = [x for x in FULL if len(x) > 5 and distance(_shape(x), shaped, 1) <= 1]
        if found:
            return frozenset(found)
    return frozenset({word})


def _given(token: str) -> bool:
    word = token.rstrip(".")
    return bool(roots(token) & FULL) and len(word) > 1


@lru_cache(maxsize=100_000)
def _kind(token: str, learned: frozenset[str]) -> str | None:
    word = token.rstrip(".")
    if word in KIND:
        return KIND[word]
    if word in learned:
        return word
    if len(word) >= 5:
        return next((k for k in (*LONG_KINDS, *sorted(learned)) if abs(len(k) - len(word)) < 3 and len(k) >= 5 and (word[0] == k[0] and distance(word, k, 1) <= 1 or len(word) > 7 and distance(word, k, 2) <= 2)), None)
    return None


#: A word is a kind if names of so many books, and such a share of all books, have it: surnames belong to few.
KIND_BOOKS, KIND_SHARE = 3, 0.05


def common_kinds(names: DataFrame) -> frozenset[str]:
    """The words of at least four letters that are in names of many books, stand behind another word in half of them at
    least, as given names do not, and are no title or the like. At most 1 / KIND_SHARE times the words of a mean book, so
    they fit the driver."""
    words = names.select("book_id", F.posexplode(F.filter(F.split(F.lower("name"), r"[^\p{L}'’]+"), lambda w: w != "")).alias("pos", "word")).where(F.length("word") >= 4)
    by_book = words.groupBy("word", "book_id").agg(F.sum((F.col("pos") > 0).cast("int")).alias("behind"), F.count(F.lit(1)).alias("times"))
    books = names.agg(F.countDistinct("book_id")).first()[0]
    counted = by_book.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("behind").alias("behind"), F.sum("times").alias("times"))
    found = counted.where((F.col("n") >= KIND_BOOKS) & (F.col("n") >= KIND_SHARE * books) & (2 * F.col("behind") >= F.col("times"))).select("word").collect()
    known = set(GIVEN) | TITLES | ENDINGS | PARTICLES | EMPTY | set(SIDES) | set(KIND)
    return frozenset(w for w in (tidy(r.word) for r in found) if len(w) >= 4 and w.isalpha() and w not in known)


def tidy(name: str) -> str:
    """Lower case without accents, digits read as the letters they stand for, possessives and outer punctuation."""
    if any(c.islower() for c in name[:-1]):  # a capital inside a word is a misread double l
        name = re.sub(r"(?<=[a-z])U(?=[a-z])", "ll", name)
    text = unicodedata.normalize("NFKD", name).lower()
    text = "".join(c for c in text if not unicodedata.combining(c)).replace("ø", "o").replace("ß", "ss").replace("ł", "l").replace("æ", "ae")
    text = unicodedata.normalize("NFC", text).translate(_CYRILLIC)
    text = re.sub(r"[’‘`´]", "'", text)
    text = re.sub(r"\s+", " ", text).strip(" \"“”;:!?*()[]。，、！？；：「」")
    text = re.sub(r"'s?$", "", text)
    return re.sub(r"(?<=[a-z])[0-9$|]+|[0-9$|]+(?=[a-z])", lambda m: m[0].translate(_OCR), text)


#: Names of more characters are compared by all of their tokens in order, as no surname or kind can be told in them; what
#: this needs grows with their length, not with its square.
LONGEST = 200

# Letters of the Russian alphabet as they are usually written in Latin ones.
_CYRILLIC = str.maketrans({c: x for c, x in zip("абвгдезийклмнопрстуфхыэё", "abvgdeziyklmnoprstufhyee")} | {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ъ": "", "ь": ""})

#: Forms: a full person, an initial and surname, one bare word, an organisation or place, an acronym, a long text, nothing.
PERSON, INITIAL, WORD, GROUP, ACRONYM, LONG, NONE = "P", "I", "W", "G", "A", "L", "N"


def parse(name: str, learned: frozenset[str] = frozenset()) -> tuple[str, str, str, str]:
    """(form, first, rest, extra) of a name. Person: roots of the given name, surname. Initial: letter, surname. Word: the
    word. Group: its kind words, its core words, its side. Acronym: its letters. Long: its tokens in the order of their
    codes. Nothing: a name without letters, as it is. learned: kind words besides the usual ones."""
    text = tidy(name)
    letters = "".join(filter(str.isalpha, text))
    if not letters:
        return NONE, "", text or name, ""
    if len(text) > LONGEST:
        return LONG, "", " ".join(sorted(re.findall(r"[^\W_]+", text), key=lambda w: (phonetic(w), w))), ""
    if re.fullmatch(r"(?:[a-z]\.){2,7}[a-z]?\.?", text):
        return ACRONYM, "", letters, ""
    text = text.replace("co-op ", "coop ").replace("co-op.", "coop.")
    text = re.sub(r"\b(m)\.\s?(d)\b\.?|\b(p)h\.?\s?(d)\b\.?", lambda m: "md" if m[1] else "phd", text)
    head, comma, tail = text.partition(",")
    while comma and tail.strip(" .").split(" ")[-1].strip(".,") in ENDINGS | {""}:
        text = head if "," not in tail else head + "," + tail.rpartition(",")[0]
        head, comma, tail = text.partition(",")
    if comma:
        text = f"{tail.strip()} {head.strip()}"
    text = re.sub(r"-(on|upon)-the-", r" \1 the ", text)
    tokens = [t for t in re.split(r"[\s,;]+", re.sub(r"(?<=\b[a-z])\.(?=[a-z])", ". ", text)) if t.strip(".'-")]
    tokens = [t.strip("'-") for t in tokens]
    while len(tokens) > 1 and tokens[-1].strip(".") in ENDINGS:
        tokens.pop()
    while len(tokens) > 1 and tokens[0].strip(".") in TITLES:
        tokens.pop(0)
    bare = [t.strip(".") for t in tokens]
    saint = [i for i, t in enumerate(bare) if t == "st"]
    kinds: list[str] = []
    core: list[str] = []
    side = ""
    for i, (t, b) in enumerate(zip(tokens, bare)):
        if b in EMPTY and len(b) > 1 or b in ("&",):
            continue
        if i in saint:
            kinds.append("street" if i == len(bare) - 1 and i else "saint")
        elif (k := _kind(t, learned)) and not (len(bare) == 2 and i == 0 and len(b) < 3 and b not in ("mt", "ft", "pt", "lk")):
            kinds.append(k)
        elif i == 0 and b in SIDES and len(bare) > 1:
            side = SIDES[b]
            core.append(b) if len(b) == 1 else None
        else:
            core.append(b)
    if kinds and core:
        core = [c for c in core if not (side and len(c) == 1)]
        return GROUP, " ".join(sorted(set(kinds))), " ".join(core), side
    if len(bare) == 1:
        word = bare[0].replace("-", "")
        for size in range(min(len(word) - 3, 12), 3, -1):
            if word[:size] in FULL:
                return PERSON, " ".join(sorted(roots(word[:size]))), word[size:].lstrip("'"), ""
        return WORD, "", word.replace("'", ""), ""
    # a person: find the given name and the surname with its particle
    if not comma and not _given(tokens[0]) and len(bare[0]) > 1 and (_given(tokens[-1]) or len(bare[-1]) == 1) and bare[0] not in PARTICLES | FULL:
        tokens = [tokens[-1], *tokens[:-1]]
    elif not comma and bare[0] in PARTICLES and len(bare) > 2 and (_given(tokens[-1]) or len(bare[-1]) == 1):
        tokens = [tokens[-1], *tokens[:-1]]
    elif bare[0] in PARTICLES and len(bare[0]) > 1 and len(bare) == 2:
        return WORD, "", "".join(bare).replace("'", "").replace("-", ""), ""
    bare = [t.strip(".") for t in tokens]
    first = tokens[0]
    for full in FULL:  # "timothymac x"
        if first.startswith(full) and first[len(full) :] in PARTICLES and first not in GIVEN:
            tokens, first = [full, first[len(full) :], *tokens[1:]], full
            bare = [t.strip(".") for t in tokens]
            break
    if len(bare) > 1 and len(first) > 2 and first[1:] in PARTICLES and first not in GIVEN:  # "bmac x"
        tokens, first = [first[0], first[1:], *tokens[1:]], first[0]
        bare = [t.strip(".") for t in tokens]
    last = len(bare) - 1
    while last > 1 and (bare[last - 1] in PARTICLES or len(bare[last - 1]) > 4 and not _given(tokens[last - 1])):
        last -= 1  # a middle word that is no given name belongs to a double surname
    surname = "".join(bare[last:]).replace("'", "").replace("-", "")
    if len(first.strip(".")) == 1:
        return INITIAL, first[0], surname, ""
    return PERSON, " ".join(sorted(roots(first))), surname, ""


#: Names of a block that one salt holds.
CROWDED = 1000

_PARSED = "book_id string, name string, form string, first string, rest string, extra string, id string, keys array<string>"


def keys_of(form: str, first: str, rest: str, extra: str) -> set[str]:
    words = rest.split(" ")
    if form == ACRONYM:
        return {f"#{rest}"}
    if form == NONE:
        return set()
    if form == LONG:  # the codes of all tokens, and those without each one, as sums of their hashes
        codes = [zlib.crc32((phonetic(w) or w).encode("utf-8", "replace")) for w in words]
        return {f"%{sum(codes)}", *(f"%{sum(codes) - c}" for c in codes)}
    keys = set().union(*(block_keys(w) for w in words))
    if form == PERSON:
        keys |= {f"{at}{rest[:1]}" for r in first.split(" ") for at in (f"@{r}", f"^{r[:1]}")}
    if form == INITIAL:
        keys.add(f"^{first}{rest[:1]}")
    if form == WORD:
        if len(rest) <= 6:
            keys.add(f"#{rest}")
        if len(rest) > 5:
            keys |= block_keys(rest[1:])
    elif form == GROUP:
        # an acronym keeps the words' order, which the parsed form has lost: all its letters, sorted
        keys.add("#" + "".join(sorted(w[0] for w in (*first.split(" "), *words))))
    return keys


def _parsed(names: DataFrame, learned: frozenset[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for book, name in rows.itertuples(index=False):
                form, first, rest, extra = parse(name, learned)
                keys = keys_of(form, first, rest, extra)
                if form in (ACRONYM, WORD) and len(rest) <= 7:
                    keys.add("#" + "".join(sorted(rest)))
                out.append((book, name, form, first, rest, extra, "\x01".join((form, first, rest, extra)), sorted(keys)))
            yield pd.DataFrame(out, columns=["book_id", "name", "form", "first", "rest", "extra", "id", "keys"])

    return fan_out(names, "book_id", "name").mapInPandas(run, _PARSED)


def _same_words(a: str, b: str) -> bool:
    x, y = a.split(" "), b.split(" ")
    return same_word(a.replace(" ", ""), b.replace(" ", "")) or len(x) == len(y) and all(same_word(p, q) for p, q in zip(x, y)) or len(x) == len(y) == 2 and same_word(x[0], y[1]) and same_word(x[1], y[0])


def _acronym_of(letters: str, kinds: str, core: str, side: str) -> bool:
    whole = sorted([w[0] for w in (*kinds.split(" "), *core.split(" "))] + ([side[0]] if side else []))
    return sorted(letters) == whole and letters[0] in {core[0], *(k[0] for k in kinds.split(" ")), side[:1]}


def compare(x: tuple[str, str, str, str], y: tuple[str, str, str, str]) -> str:
    """'same' if two names of one book are the same entity by themselves; 'may' if the one, an initial, a bare word or an
    acronym, could stand for the other; '' if neither."""
    if "PIGWALN".index(x[0]) > "PIGWALN".index(y[0]):
        x, y = y, x
    (f, a, s, e), (g, b, t, h) = x, y
    if LONG in (f, g):
        p, q = s.split(" "), t.split(" ")
        return "same" if f == g and len(p) == len(q) and all(same_word(v, w) for v, w in zip(p, q)) else ""
    if f == g == PERSON:
        if not same_word(s, t):
            return ""
        p, q = set(a.split(" ")), set(b.split(" "))
        if p & q:
            return "same" if p == q or len(p) == 1 or len(q) == 1 else "may"
        if not (p & FULL) and not (q & FULL) and same_word(a, b):
            return "same"
        return ""
    if f == PERSON and g == INITIAL:
        return "may" if any(r[0] == b for r in a.split(" ")) and same_word(s, t) else ""
    if f in (PERSON, INITIAL) and g == WORD:
        if len(t) > 5 and same_word(s, t[1:]) and distance(s, t[1:], 3) < distance(s, t, 3):
            return "may" if any(r[0] == t[0] for r in a.split(" ")) else ""
        return "may" if same_word(s, t) else ""
    if f == g == INITIAL:
        return "same" if a == b and same_word(s, t) else ""
    if f == g == GROUP:
        k, m = set(a.split(" ")), set(b.split(" "))
        return "same" if e == h and (k <= m or m <= k) and _same_words(s, t) else ""
    if f == GROUP and g == WORD:
        return "may" if same_word(s.replace(" ", ""), t) or len(t) <= 7 and _acronym_of(t, a, s, e) else ""
    if f == GROUP and g == ACRONYM:
        return "may" if _acronym_of(t, a, s, e) else ""
    if f == g == WORD:
        return "same" if same_word(s, t) else ""
    if {f, g} == {WORD, ACRONYM}:
        return "same" if s == t else ""
    return "same" if f == g == ACRONYM and s == t else ""


def _compared(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            verdicts = [compare(tuple(a.split("\x01")), tuple(b.split("\x01"))) for a, b in zip(rows["a"], rows["b"])]
            kept = rows.assign(verdict=verdicts)
            yield kept[kept["verdict"] != ""]

    return pairs.mapInPandas(run, "book_id string, a string, b string, verdict string")


def link_names(names: DataFrame) -> DataFrame:
    """(book_id, name, entity) of each distinct (book_id, name): names of one entity have the same `entity`, the smallest
    parsed form in it. Rows with a null book or name are left out; names without any letter are only alike after tidying
    (case, white space, outer punctuation); names in other scripts are compared by their letters, Russian ones as written in
    Latin; names of more than LONGEST characters by all of their tokens. Repeated rows count once; no rows give none. Extra
    columns are ignored.

    Names that parse alike are one row from the blocking on. A block is the pairs of one book with a common phonetic key;
    the pairs come from a join and are compared in batches, so no block is held in one place. One side of a crowded block
    is spread over salts and the other repeated for each, so that no task has a whole one.
    """
    distinct = cut(names.where(F.col("book_id").isNotNull() & F.col("name").isNotNull()).select("book_id", "name").distinct(), "names")
    parsed = cut(_parsed(distinct, common_kinds(distinct)), "parsed")
    forms = parsed.groupBy("book_id", "id").agg(F.first("keys").alias("keys"))
    keyed = cut(forms.select("book_id", "id", F.explode("keys").alias("key")), "keyed")
    crowded = cut(keyed.groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("book_id", "key", F.ceil(F.col("n") / CROWDED).cast("int").alias("salts")), "crowded")
    salted = keyed.join(crowded, ["book_id", "key"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    one = salted.select("book_id", "key", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("a"))
    two = salted.select("book_id", "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("b"))
    pairs = one.join(two, ["book_id", "key", "salt"]).where("a < b").select("book_id", "a", "b").distinct()
    verdicts = cut(_compared(pairs), "verdicts")
    node = lambda c: F.concat_ws("\x02", "book_id", c)
    same = verdicts.where("verdict = 'same'").select(node("a").alias("a"), node("b").alias("b"))
    labels = minimum_labels(same).select(F.col("id").alias("node"), "label")
    nodes = forms.select(node("id").alias("node"), F.substring("id", 1, 1).alias("form"))
    labelled = cut(nodes.join(labels, "node", "left").select("node", "form", F.coalesce("label", "node").alias("label")), "labelled")
    may = verdicts.where("verdict = 'may'").select(node("a").alias("a"), node("b").alias("b"))
    ends = (
        may.join(labelled.select(F.col("node").alias("a"), F.col("form").alias("form_a"), F.col("label").alias("label_a")), "a")
        .join(labelled.select(F.col("node").alias("b"), F.col("form").alias("form_b"), F.col("label").alias("label_b")), "b")
        .where("label_a <> label_b")
    )
    # the less certain end joins the more certain one
    rank = lambda c: F.when(F.col(c).isin("P", "G"), 0).when(F.col(c) == "I", 1).otherwise(2)
    turned = ends.select(
        F.when(rank("form_a") > rank("form_b"), F.struct("label_a", "label_b", rank("form_a").alias("r"))).otherwise(F.struct(F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b"), rank("form_b").alias("r"))).alias("x")
    ).select(F.col("x.label_a").alias("weak"), F.col("x.label_b").alias("strong"), F.col("x.r").alias("r"))
    only = lambda df: df.groupBy("weak").agg(F.min("strong").alias("low"), F.max("strong").alias("high")).where("low = high").select("weak", F.col("low").alias("strong"))
    initials = only(turned.where("r < 2"))
    moved = labelled.join(initials, labelled["label"] == initials["weak"], "left").select("node", "form", F.coalesce("strong", "label").alias("label"), F.col("label").alias("was"))
    moved = cut(moved, "moved")
    now = moved.select(F.col("was").alias("strong"), F.col("label").alias("now")).distinct()
    words = only(turned.where("r = 2").join(now, "strong").select("weak", F.col("now").alias("strong")))
    final = moved.join(words, moved["label"] == words["weak"], "left").select("node", F.coalesce("strong", "label").alias("entity"))
    return parsed.select("book_id", "name", node("id").alias("node")).join(final, "node").select("book_id", "name", F.split("entity", "\x02").getItem(1).alias("entity"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(book_id, name_a, name_b) of all two spellings of one entity, name_a < name_b by bytes."""
    a = linked.select("book_id", "entity", F.col("name").alias("name_a"))
    b = linked.select("book_id", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["book_id", "entity"]).where("name_a < name_b").select("book_id", "name_a", "name_b")
