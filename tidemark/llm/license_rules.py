"""The signature rules of the licence scan.

A name is a regular expression over words that single spaces part; ``^`` stands
before its anchor, the keyword that has to occur in a text before any rule with
that anchor is tried.  The second field of a name is a further word that must
stand near it.  Every name gives two rules, a notice (``released under the ...``)
and a bare mention; every identifier gives one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases that count wherever they stand, with their labels: fixed values of the contract.
BASE = (("mit", "under the mit ^license"), ("apache-2", "apache ^license version 2"), ("cc-by-nc", "^cc by nc"))

NOTICE = r"(?:licensed|released|distributed|available|published|provided|covered|offered|governed|redistributed|dual licensed|made available) (?:under|by|according to|subject to|in accordance with)(?: the| an| a)?(?: terms of(?: the| an| a)?| conditions of(?: the)?| terms and conditions of(?: the)?)?"

_L = "^licen[sc]es?"
#: label: names.  Written by hand, one row for each licence, most particular names first.
NAMES = {
    "mit": (f"mit {_L}", f"mit x11 {_L}", f"expat {_L}", f"mit style {_L}"),
    "mit-0": (f"mit no attribution {_L}", f"mit 0 {_L}"),
    "apache-2": (f"apache {_L}(?: version)? 2(?: 0)?", f"apache software {_L}(?: version)? 2(?: 0)?", f"apache 2(?: 0)? {_L}", f"apl 2(?: 0)? {_L}"),
    "apache-1.1": (f"apache (?:software )?{_L}(?: version)? 1 1",),
    "apache": (f"apache (?:software )?{_L}",),
    "bsd-3-clause": (f"bsd 3 clause {_L}", f"3 clause bsd {_L}", f"(?:new|revised|modified) bsd {_L}", f"three clause bsd {_L}"),
    "bsd-2-clause": (f"bsd 2 clause {_L}", f"2 clause bsd {_L}", f"(?:simplified|freebsd) bsd {_L}", f"two clause bsd {_L}"),
    "bsd-4-clause": (f"4 clause bsd {_L}", f"original bsd {_L}"),
    "0bsd": (f"zero clause bsd {_L}", f"0bsd {_L}"),
    "bsd": (f"bsd {_L}", f"bsd (?:style|type) {_L}"),
    "gpl-1": (f"gnu general public {_L}(?: gpl)?(?: version)? v?1", "^gpl(?: version)? v?1"),
    "gpl-2": (f"gnu general public {_L}(?: gpl)?(?: version)? v?2(?: 0)?", "^gpl(?: version)? v?2(?: 0)?", "^gplv2", f"gnu gpl {_L}(?: version)? v?2"),
    "gpl-3": (f"gnu general public {_L}(?: gpl)?(?: version)? v?3(?: 0)?", "^gpl(?: version)? v?3(?: 0)?", "^gplv3", f"gnu gpl {_L}(?: version)? v?3"),
    "gpl": (f"gnu general public {_L}", f"gnu gpl {_L}", f"gpl {_L}"),
    "lgpl-2": (f"gnu library general public {_L}(?: version)? v?2(?: 0)?", "^lgpl(?: version)? v?2(?: 0)?"),
    "lgpl-2.1": (f"gnu lesser general public {_L}(?: version)? v?2 1", "^lgpl(?: version)? v?2 1", "^lgplv2 1"),
    "lgpl-3": (f"gnu lesser general public {_L}(?: version)? v?3(?: 0)?", "^lgpl(?: version)? v?3(?: 0)?", "^lgplv3"),
    "lgpl": (f"gnu lesser general public {_L}", f"lgpl {_L}"),
    "agpl-3": (f"gnu affero general public {_L}(?: version)? v?3(?: 0)?", "^agpl(?: version)? v?3(?: 0)?", "^agplv3"),
    "agpl": (f"(?:gnu )?affero general public {_L}", f"agpl {_L}"),
    "gfdl-1.3": (f"gnu free documentation {_L}(?: version)? 1 3", "^gfdl(?: version)? 1 3"),
    "gfdl": (f"gnu free documentation {_L}", f"gfdl {_L}"),
    "mpl-1.1": (f"mozilla public {_L}(?: version)? 1 1", "^mpl(?: version)? 1 1"),
    "mpl-2": (f"mozilla public {_L}(?: version)? v?2(?: 0)?", "^mpl(?: version)? v?2(?: 0)?"),
    "mpl": (f"mozilla public {_L}",),
    "epl-1": (f"eclipse public {_L}(?: version)? v?1(?: 0)?", "^epl(?: version)? v?1(?: 0)?"),
    "epl-2": (f"eclipse public {_L}(?: version)? v?2(?: 0)?", "^epl(?: version)? v?2(?: 0)?"),
    "epl": (f"eclipse public {_L}",),
    "edl-1": (f"eclipse distribution {_L}",),
    "cddl-1": (f"common development and distribution {_L}(?: version)? 1(?: 0)?", "^cddl(?: version)? v?1(?: [01])?"),
    "cddl": (f"common development and distribution {_L}",),
    "cpl-1": (f"common public {_L}(?: version)? 1(?: 0)?",),
    "cpal-1": (f"common public attribution {_L}",),
    "ibm-pl": (f"ibm public {_L}",),
    "isc": (f"isc {_L}", f"internet systems consortium {_L}"),
    "zlib": (f"zlib {_L}", f"zlib libpng {_L}"),
    "libpng": (f"libpng {_L}",),
    "bsl-1": (f"boost software {_L}(?: version)?(?: 1(?: 0)?)?", f"boost {_L}"),
    "unlicense": ("the ^unlicense", "^unlicense"),
    "wtfpl": (f"do what the fuck you want to public {_L}", "^wtfpl"),
    "artistic-1": (f"artistic {_L}(?: version)? 1(?: 0)?",),
    "artistic-2": (f"artistic {_L}(?: version)? 2(?: 0)?",),
    "artistic": (f"artistic {_L}", f"perl {_L}"),
    "psf-2": (f"python software foundation {_L}", f"psf {_L}", f"python {_L}"),
    "postgresql": (f"postgresql {_L}",),
    "php-3": (f"php {_L}(?: version)?(?: 3(?: 0?1)?)?",),
    "ruby": (f"ruby {_L}",),
    "openssl": (f"openssl {_L}",),
    "w3c": (f"w3c software(?: notice and)? {_L}", f"w3c {_L}"),
    "ofl-1.1": (f"sil open font {_L}(?: version)?(?: 1 1)?", f"open font {_L}", "^ofl 1 1"),
    "eupl-1.2": (f"european union public {_L}(?: version)?(?: v)?(?: 1 2)?", "^eupl(?: v?1 2)?"),
    "cecill-2.1": (f"cecill(?: [abc])? {_L}",),
    "sspl-1": (f"server side public {_L}", "^sspl(?: v?1)?"),
    "busl-1.1": (f"business source {_L}(?: 1 1)?",),
    "elastic-2": (f"elastic {_L}(?: version)?(?: 2(?: 0)?)?",),
    "polyform": (f"polyform (?:noncommercial|small business|shield|strict) {_L}",),
    "ms-pl": (f"microsoft public {_L}",),
    "ms-rl": (f"microsoft reciprocal {_L}",),
    "ncsa": (f"university of illinois ncsa open source {_L}", f"ncsa {_L}"),
    "afl-3": (f"academic free {_L}",),
    "osl-3": (f"open software {_L}",),
    "ecl-2": (f"educational community {_L}",),
    "lppl-1.3": (f"latex project public {_L}",),
    "vim": (f"vim {_L}",),
    "x11": (f"x11 {_L}", f"x consortium {_L}"),
    "upl-1": (f"universal permissive {_L}",),
    "blueoak-1": (f"blue oak model {_L}",),
    "hpnd": (f"historical permission notice and disclaimer {_L}",),
    "qpl-1": (f"q public {_L}",),
    "sleepycat": (f"sleepycat {_L}",),
    "beerware": (f"beer ?ware {_L}",),
    "odbl-1": (f"open (?:data commons open )?database {_L}", "^odbl(?: 1 0)?"),
    "odc-by-1": (f"open data commons attribution {_L}",),
    "pddl-1": (f"public domain dedication and {_L}", "^pddl(?: 1 0)?"),
    "ogl-3": (f"open government {_L}(?: v?3(?: 0)?)?",),
    "openrail": (f"(?:creativeml )?open ?rail(?: m)? {_L}", f"bigscience rail {_L}"),
    "cc0-1": ("^cc0(?: 1 0)?", "^cc 0(?: 1 0)?", f"creative commons zero(?: {_L})?"),
    "cc-by": ("^cc by(?: [1-4] [05])?", f"creative commons attribution(?: [1-4] [05])?(?: international| unported)? {_L}"),
    "cc-by-sa": ("^cc by sa(?: [1-4] [05])?", f"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)? {_L}"),
    "cc-by-nd": ("^cc by nd(?: [1-4] [05])?", f"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)? {_L}"),
    "cc-by-nc": ("^cc by nc(?: [1-4] [05])?", f"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)? {_L}"),
    "cc-by-nc-sa": ("^cc by nc sa(?: [1-4] [05])?", f"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)? {_L}"),
    "cc-by-nc-nd": ("^cc by nc nd(?: [1-4] [05])?", f"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)? {_L}"),
    "proprietary": (f"proprietary {_L}", "^copyright [0-9]{4} [^ ]+(?: [^ ]+){0,4} all rights reserved", f"commercial {_L} only"),
}

#: label: the identifier as words after "spdx license identifier".
IDENTIFIERS = {
    "mit": "mit", "mit-0": "mit 0", "apache-2": "apache 2 0", "apache-1.1": "apache 1 1", "bsd-3-clause": "bsd 3 clause", "bsd-2-clause": "bsd 2 clause", "bsd-4-clause": "bsd 4 clause", "0bsd": "0bsd",
    "gpl-2": "gpl 2 0(?: only| or later)?", "gpl-3": "gpl 3 0(?: only| or later)?", "lgpl-2.1": "lgpl 2 1(?: only| or later)?", "lgpl-3": "lgpl 3 0(?: only| or later)?", "agpl-3": "agpl 3 0(?: only| or later)?", "gfdl-1.3": "gfdl 1 3(?: only| or later)?",
    "mpl-1.1": "mpl 1 1", "mpl-2": "mpl 2 0", "epl-1": "epl 1 0", "epl-2": "epl 2 0", "cddl-1": "cddl 1 0", "isc": "isc", "zlib": "zlib", "bsl-1": "bsl 1 0", "unlicense": "unlicense", "wtfpl": "wtfpl", "artistic-2": "artistic 2 0",
    "psf-2": "psf 2 0", "postgresql": "postgresql", "ofl-1.1": "ofl 1 1", "eupl-1.2": "eupl 1 2", "busl-1.1": "busl 1 1", "elastic-2": "elastic 2 0", "ms-pl": "ms pl", "ncsa": "ncsa", "ecl-2": "ecl 2 0", "x11": "x11", "upl-1": "upl 1 0",
    "cc0-1": "cc0 1 0", "cc-by": "cc by [1-4] [05]", "cc-by-sa": "cc by sa [1-4] [05]", "cc-by-nd": "cc by nd [1-4] [05]", "cc-by-nc": "cc by nc [1-4] [05]", "cc-by-nc-sa": "cc by nc sa [1-4] [05]", "cc-by-nc-nd": "cc by nc nd [1-4] [05]",
}

#: The words that an anchor of the rules can be.
FORMS = {"licen[sc]es?": ("license", "licence", "licenses", "licences")}
#: Words on either side of an anchor that a rule may look at.
BEFORE, AFTER = 22, 12


@dataclass(frozen=True)
class Rule:
    label: str
    anchors: tuple[str, ...]
    pattern: str  # over " word word |anchor word "
    priority: int  # of rules that find the same words, the least
    weight: float
    key: str  # must stand near the anchor for the expression to be tried
    base: bool = False


def _rule(label: str, name: str, priority: int, weight: float, base: bool = False) -> Rule:
    before, _, after = name.partition("^")
    form = next((f for f in FORMS if after.startswith(f)), None)
    word = form or after.split(" ")[0].split("(")[0]
    plain = re.split(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??|[ a-z0-9]\?|\[[^]]*\]\S*", f"{before.removeprefix(NOTICE)}|{after if form is None else ''}")
    key = max((w for part in plain for w in part.replace("|", " ").split()), key=len, default="")
    return Rule(label, FORMS.get(form, (word,)), f" {before}\\|{after} ", priority, weight, key, base)


def _rules() -> list[Rule]:
    out = [_rule(label, name, 0, 1.0, True) for label, name in BASE]
    out += [_rule(label, f"^spdx license identifier {name}", 1, 1.0) for label, name in IDENTIFIERS.items()]
    names = [(label, name, 10 * k + j) for k, (label, names) in enumerate(NAMES.items()) for j, name in enumerate(names)]
    out += [_rule(label, f"{NOTICE} {name}", 100 + p, 0.95) for label, name, p in names]
    return out + [_rule(label, name, 2000 + p, 0.6) for label, name, p in names]


RULES = _rules()
ANCHORS = sorted({a for r in RULES for a in r.anchors})
