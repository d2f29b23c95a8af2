"""Names as people type them: parsing persons and organisations, nicknames, slips and abbreviations."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from polispark.llm.canonical import abbreviates, one_slip, slips

#: Nicknames and written abbreviations of given names.
NICKNAMES = {
    "abigail": "abby gail abbie", "albert": "al bert bertie", "alexander": "alex alec sandy xander al", "alfred": "alf fred al", "amanda": "mandy", "andrew": "andy drew andw",
    "angela": "angie", "anthony": "tony ant", "arthur": "art artie", "augustus": "gus augie", "barbara": "barb babs barbie", "bartholomew": "bart bat",
    "benjamin": "ben benj benji benny", "catherine": "cathy kate cath", "charles": "chas chuck charlie", "christina": "tina chris", "christine": "chris tina chrissy", "christopher": "chris topher kit",
    "clifford": "cliff", "cornelius": "neil connie corny", "cynthia": "cindy", "daniel": "dan danl danny", "david": "dave davey", "deborah": "deb debbie",
    "dolores": "lola", "donald": "don donnie", "dorothy": "dot dottie dolly", "douglas": "doug", "ebenezer": "eben", "edgar": "ed", "eduardo": "lalo ed eddie",
    "edward": "ed eddie edw ted teddy ned", "edwin": "ed eddie", "eleanor": "ellie nora nell", "elizabeth": "liz eliz beth betsy betty lizzie", "ernesto": "neto ernie", "eugene": "gene",
    "florence": "flo flossie", "francis": "frank frankie", "francisco": "paco pancho", "frederick": "fred fredk freddy freddie", "george": "geo georgie", "gerald": "jerry gerry", "gregory": "greg",
    "guadalupe": "lupe lupita", "gwendolyn": "gwen wendy", "harold": "hal harry", "harriet": "hattie", "henry": "hank harry hal", "ignacio": "nacho", "isabella": "izzy bella", "jacob": "jake",
    "jacqueline": "jackie", "james": "jim jimmy jas jamie", "jennifer": "jen jenny", "jerome": "jerry", "john": "johnny jack jno", "jonathan": "jon jonny", "jose": "pepe", "joseph": "joe joey jos",
    "josephine": "josie jo", "joshua": "josh", "katherine": "kate kath kathy katie kay", "kathleen": "kathy kath", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry lawr lars",
    "leonard": "len lenny leo", "madeline": "maddie", "margaret": "maggie meg peggy margt marge", "martin": "marty", "matthew": "matt matty", "melvin": "mel", "mercedes": "merche", "michael": "mike mick michl mickey",
    "nathaniel": "nat nate", "nicholas": "nick nicky", "oliver": "ollie", "pamela": "pam", "patricia": "patty tricia pat trish", "patrick": "pat paddy", "philip": "phil", "rafael": "rafa", "randall": "randy",
    "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich richd richie", "robert": "bob bobby rob robt robbie", "roberto": "beto", "roderick": "rod roddy", "ronald": "ron ronnie", "rosario": "charo",
    "russell": "russ", "samuel": "sam sammy saml", "samantha": "sam", "sebastian": "seb", "stanley": "stan", "stephanie": "steph stevie", "stephen": "steve", "steven": "steve", "susan": "sue susie", "suzanne": "suzy sue",
    "terrence": "terry", "theodore": "ted teddy theo", "thomas": "tom tommy thos", "timothy": "tim timmy", "tobias": "toby", "valerie": "val", "veronica": "ronni vera ronnie", "victoria": "vicky tori vickie",
    "vincent": "vince vinny vin", "virginia": "ginny", "walter": "walt wally", "wilfred": "wilf", "wilhelmina": "mina willa minnie", "william": "bill billy wm will", "winifred": "winnie", "zachary": "zach zack",
}
_FORMAL: dict[str, set[str]] = {}
for _name, _nicks in NICKNAMES.items():
    for _n in _nicks.split():
        _FORMAL.setdefault(_n, set()).add(_name)

#: Titles, generations, legal forms and fillers.
TITLES = set("mr mrs ms miss dr hon honorable rep representative sen senator assm assemblymember assemblyman delegate gov prof rev md phd esq cpa jd dds dvm rn ret mx sir".split())
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
LEGAL = set("co company corp corporation inc incorporated llc llp lp ltd limited plc".split())
COMMITTEE = set("pac political action committee pol cmte".split())
FILLERS = {
    "self", "self employed", "selfemployed", "retired", "none", "na", "n a", "not employed", "unemployed", "refused", "information requested", "requested", "unknown", "various", "homemaker", "student",
    "information requested per best efforts", "best efforts", "same", "see above", "not applicable", "anonymous", "other", "disabled", "not provided", "not available", "null", "nil", "xx", "tbd", "pending",
}
_AGGREGATE = re.compile(r"aggregate|unitemi[sz]ed|itemi[sz]ed|small (donors|contributions)|pac/committee contributions|various (donors|contributors)")


class Name(NamedTuple):
    kind: str  # person, org, or none for what names nobody
    surname: str
    core: str  # given name (or its initial), or trade
    middle: str  # initials
    tag: str  # generation, or 'pac'
    nick: str


NOBODY = Name("none", "", "", "", "", "")


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if unicodedata.category(c) not in ("Mn", "Cf"))


def plain(s: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", fold(s)))


def nobody(s: str) -> bool:
    """Whether a string is a filler or an aggregate, or has no word."""
    p = plain(s)
    return len(p) < 2 or p in FILLERS or bool(_AGGREGATE.search(fold(s)))


def looks_legal(s: str) -> bool:
    """Whether a string has the legal form of a company or the name of a committee."""
    ws = plain(re.sub(r"\b((?:\w\.){2,})", lambda x: x.group(1).replace(".", ""), s)).split()
    return any(w in LEGAL or w == "pac" for w in ws[1:]) or "action" in ws


def formal(given: str) -> set[str]:
    """The formal names that a given name may stand for, itself included."""
    return {given} | _FORMAL.get(given, set())


def _words(part: str) -> list[str]:
    return [re.sub(r"[^\w]", "", w) for w in part.split() if re.sub(r"[^\w]", "", w)]


def person(raw: str, given: frozenset[str] | set[str] = frozenset()) -> Name:
    """Surname, given name, middle initials, generation and nickname; `given` holds known given names."""
    s = fold(raw)
    nick = ""
    m = re.search(r"[\"“(]\s*([^\W\d_]{2,})\s*[\"”)]", s)
    if m:
        nick, s = m.group(1), s[: m.start()] + " " + s[m.end():]
    s = re.sub(r"(?<=\w)-(?=\w)", "", re.sub(r"\b((?:\w\.){2,})", lambda x: x.group(1).replace(".", ""), s))
    tag, parts = "", []
    for part in s.split(","):
        keep = []
        for w in _words(part):
            if w in GENERATIONS and (keep or parts or len(_words(s)) > 1):
                tag = tag or GENERATIONS[w]
            elif w not in TITLES:
                keep.append(w)
        if keep:
            parts.append(keep)
    if not parts:
        return NOBODY
    known = lambda w: w in given or w in NICKNAMES or w in _FORMAL
    if len(parts) > 1:
        last, rest = parts[0], [w for p in parts[1:] for w in p]
        long = [w for w in rest if len(w) > 1]
        first = long[0] if long else rest[0]
        middle = [w[0] for w in rest if w is not first] if long else [w[0] for w in rest[1:]]
        return Name("person", "".join(last), first, "".join(middle[:1]), tag, nick)
    ws = parts[0]
    long = [w for w in ws if len(w) > 1]
    hit = next((w for w in long if known(w)), None) if len(long) > 1 else None
    if hit is None and len(long) > 1 and len(ws[0]) == 1:
        hit = ws[0] if not any(known(w) for w in long) else None
    if hit is None and len(long) > 1:
        hit = long[0]
    if hit is not None:
        rest = list(ws)
        rest.remove(hit)
        return Name("person", "".join(w for w in rest if len(w) > 1), hit, "".join(w for w in rest if len(w) == 1)[:1], tag, nick)
    short = [w for w in ws if len(w) == 1]
    if not long:
        return NOBODY
    return Name("person", long[0], short[0] if short else "", "".join(short[1:2]), tag, nick)


def organisation(raw: str, trades: frozenset[str] | set[str] = frozenset()) -> Name:
    """Family name, trade and whether it is a committee; legal forms and the article are left out."""
    s = re.sub(r"['’]", "", re.sub(r"\b((?:\w\.){2,})", lambda x: x.group(1).replace(".", ""), fold(raw)))
    drop = LEGAL | {"the", "and", "of"}
    parts, pac = [], False
    for part in s.split(","):
        ws = re.findall(r"[^\W_]+", part)
        pac = pac or "pac" in ws or ("action" in ws and ("committee" in ws or "cmte" in ws))
        keep = [w for w in ws if w not in drop and not (w in COMMITTEE)]
        while len(keep) > 1 and len(keep[-1]) == 1 and len(keep[-2]) < 3:  # letters that stand alone make one word
            keep[-2:] = ["".join(keep[-2:])]
        if keep:
            parts.append(keep)
    ws = [w for p in parts for w in p]
    if not ws:
        return NOBODY
    if len(parts) > 1:
        return Name("org", "".join(parts[1]), "".join(parts[0]), "", "pac" if pac else "", "")
    if len(ws) == 1:
        return Name("org", ws[0], "", "", "pac" if pac else "", "")
    cut = 1 if "".join(ws[1:]) in trades else len(ws) - 1
    return Name("org", "".join(ws[:cut]), "".join(ws[cut:]), "", "pac" if pac else "", "")


__all__ = ["NOBODY", "Name", "abbreviates", "fold", "formal", "nobody", "one_slip", "organisation", "person", "plain", "slips"]
