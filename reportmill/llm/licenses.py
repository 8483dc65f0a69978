"""License scans: notice phrases and identifier tags by Aho-Corasick, license expressions by a shunting-yard parser.

A text's words are runs of a-z, 0-9 and anything beyond ASCII after A-Z is lower-cased. One automaton over the words joined
by single spaces finds all notice phrases and the identifier tag in one pass, whatever their number; places are numbered along the way, so a text costs time in proportion to its length.
Where the tag is found, the expression behind it, up to the line's end, and where phrases are joined by one of the three words, their labels
are parsed (``with`` binds tighter than ``and``, and that tighter than ``or``) and evaluated: to the labels of the licenses that it names, and to whether
its terms can all be met by permissive licenses (``or`` needs one side, ``and`` both).

Base phrases count towards ``n_base``, ``first_word``, ``last_word`` and ``base_labels``; further phrases and expressions add to ``labels`` alone.
``score`` is ``1 - 2^-(places + 2 * expressions)``: 0 without any evidence, towards 1 with more.

Rows: null or empty text has no words and no places; null ids and repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from reportmill.llm import _common as c

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further phrases and their labels.
FURTHER_PHRASES = {
    "academic free license": "afl",
    "all rights reserved": "reserved",
    "apache software license": "apache",
    "apple public source license": "apsl",
    "artistic license": "artistic",
    "attribution sharealike": "cc-by-sa",
    "beerware license": "beerware",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "business source license": "busl",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "cecill": "cecill",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "creative commons": "cc",
    "wtfpl": "wtfpl",
    "eclipse distribution license": "bsd",
    "eclipse public license": "epl",
    "educational community license": "ecl",
    "elastic license": "elastic",
    "european union public licence": "eupl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gpl compatible": "gpl",
    "in the software without restriction including without limitation the rights": "mit",
    "isc license": "isc",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "mozilla public license": "mpl",
    "open data commons attribution license": "odc-by",
    "open database license": "odbl",
    "open font license": "ofl",
    "open software license": "osl",
    "openssl license": "openssl",
    "php license": "php",
    "postgresql license": "postgresql",
    "proprietary and confidential": "proprietary",
    "public domain": "public-domain",
    "python software foundation license": "psf",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "server side public license": "sspl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "universal permissive license": "upl",
    "unlicense": "unlicense",
    "vim license": "vim",
    "w3c software notice and license": "w3c",
    "x11 license": "x11",
    "zlib license": "zlib",
    "zope public license": "zpl",
}
# Families of identifiers in the public license list and the versions or forms that follow them, each behind a hyphen.
FAMILIES = {
    "0bsd": "", "aal": "", "afl": "1.1 1.2 2.0 2.1 3.0", "agpl": "1.0 3.0", "apache": "1.0 1.1 2.0", "apsl": "1.0 1.1 1.2 2.0", "artistic": "1.0 1.0-cl8 1.0-perl 2.0",
    "beerware": "", "bittorrent": "1.0 1.1", "blueoak": "1.0.0", "bsd": "1-clause 2-clause 2-clause-patent 2-clause-views 3-clause 3-clause-attribution 3-clause-clear 3-clause-lbnl 4-clause 4-clause-uc protection source-code",
    "bsl": "1.0", "busl": "1.1", "cc-by": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-nd": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-sa": "1.0 2.0 2.5 3.0 4.0", "cc-by-nd": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-sa": "1.0 2.0 2.5 3.0 4.0", "cc-pddc": "", "cc0": "1.0", "cddl": "1.0 1.1", "cecill": "1.0 1.1 2.0 2.1 b c", "cpal": "1.0", "cpl": "1.0", "curl": "", "ecl": "1.0 2.0", "efl": "1.0 2.0", "elastic": "2.0", "epl": "1.0 2.0",
    "eupl": "1.0 1.1 1.2", "fsfap": "", "ftl": "", "gfdl": "1.1 1.2 1.3", "gpl": "1.0 2.0 3.0", "hpnd": "", "icu": "", "ijg": "", "intel": "", "ipl": "1.0", "isc": "", "jasper": "2.0", "json": "", "lgpl": "2.0 2.1 3.0", "libpng": "2.0",
    "lppl": "1.0 1.1 1.2 1.3a 1.3c", "mit": "0 cmu advertising enna feh modern-variant", "mpl": "1.0 1.1 2.0 2.0-no-copyleft-exception", "ms-pl": "", "ms-rl": "", "mulanpsl": "1.0 2.0", "ncsa": "", "odbl": "1.0", "odc-by": "1.0",
    "ofl": "1.0 1.1", "openssl": "", "osl": "1.0 1.1 2.0 2.1 3.0", "pddl": "1.0", "php": "3.0 3.01", "postgresql": "", "psf": "2.0", "python": "2.0 2.0.1", "qpl": "1.0", "ruby": "", "sgi-b": "1.0 1.1 2.0", "sissl": "1.2", "sleepycat": "", "spl": "1.0",
    "sspl": "1.0", "tcl": "", "unicode": "dfs-2015 dfs-2016 tou 3.0", "unlicense": "", "upl": "1.0", "vim": "", "w3c": "19980720 20150513", "wtfpl": "", "x11": "", "xnet": "", "zend": "2.0", "zlib": "", "zpl": "1.1 2.0 2.1",
}
# Families whose terms are permissive, and those whose identifiers also come with "-only", "-or-later" or "+".
PERMISSIVE = {*"0bsd aal afl apache artistic beerware blueoak bsd bsl cc-by cc-pddc cc0 curl ecl efl fsfap ftl hpnd icu ijg intel isc json libpng mit mulanpsl ncsa odc-by ofl openssl pddl php postgresql psf python ruby tcl unicode unlicense upl vim w3c wtfpl x11 xnet zend zlib zpl".split()}
LATER = {"agpl", "gfdl", "gpl", "lgpl"}
# Exceptions that may follow "with".
EXCEPTIONS = {
    *"389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-1.24 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0 cryptsetup-openssl-exception ecos-exception-2.0".split(),
    *"fltk-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 libtool-exception linux-syscall-note llvm-exception lzma-exception mif-exception nokia-qt-exception-1.1".split(),
    *"ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0 openvpn-openssl-exception ps-or-pdf-font-exception-20170817 qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 swift-exception u-boot-exception-2.0".split(),
    *"universal-foss-exception-1.0 wxwindows-exception-3.1".split(),
}
TAG = "spdx license identifier"


@functools.lru_cache(maxsize=1)
def identifiers() -> dict[str, str]:
    """Every identifier that the rules above make, with its family."""
    known = {}
    for name, forms in FAMILIES.items():
        for one in [name, *(f"{name}-{x}" for x in forms.split())]:
            known[one] = known[f"{one}+"] = name
            if name in LATER:
                known[f"{one}-only"] = known[f"{one}-or-later"] = name
    return known


_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TAGGED = re.compile(rb"spdx-license-identifier[ \t]*:?[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\s*([()]|[a-z0-9][a-z0-9.+:-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str]:
    """The longest valid expression at the start of a text, in postfix order; empty if there is none.

    An operator without a right side, an open parenthesis or whatever follows a complete expression ends it.
    """
    best: list[str] = []
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether an operand comes next
    at = 0
    while m := _TOKEN.match(expression, at):
        at, token = m.end(), m[1]
        if operand:
            if token == "(":
                held.append(token)
                continue
            if token == ")" or token in _BINDS:
                break
            out.append(token)
            operand = False
        elif token in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        else:
            break
        if not operand and "(" not in held:
            best = out + held[::-1]
    return best


def family(identifier: str) -> str:
    """The label of an identifier: its family, that of the longest known identifier that it carries on, or itself."""
    known = identifiers()
    if identifier in known:
        return known[identifier]
    parts = identifier.rstrip("+").split("-")
    return next((known[x] for n in range(len(parts), 0, -1) if (x := "-".join(parts[:n])) in known), identifier)


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Labels of the licenses named, and whether permissive ones suffice. ``with`` a known exception keeps its license's terms;
    with one that isn't known they are not taken for permissive."""
    stack: list[tuple[set[str], bool, str]] = []
    for token in postfix:
        if token in _BINDS:
            (b, free_b, said), (a, free_a, _) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((a, free_a and said in EXCEPTIONS, ""))
            else:
                stack.append((a | b, free_a and free_b if token == "and" else free_a or free_b, ""))
        else:
            label = family(token)
            stack.append(({label}, label in PERMISSIVE, token))
    return stack[0][:2]


def joined_phrases(named: list[tuple[int, int, str]], words: list[bytes]) -> list[list[str]]:
    """Expressions of notice phrases with one of "and", "or" and "with" between them: "mit license or apache license". Of places that overlap the first and longest counts."""
    found, said, last = [], [], None
    for first, end, label in sorted(named, key=lambda x: (x[0], -x[1])):
        if last is not None and first < last:
            continue
        joint = words[last].decode("latin-1") if last is not None and first == last + 1 else ""
        if joint in _BINDS:
            said += [joint, label]
        else:
            found.append(said)
            said = [label]
        last = end
    return [to_postfix(" ".join(x)) for x in [*found, said] if len(x) > 1]


@functools.lru_cache(maxsize=4)
def automaton(phrases: tuple[tuple[str, str, bool], ...]):
    """(phrase, label, base) of each phrase, and the tag."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase, label, base in phrases:
        made.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, base))
    made.add_word(f" {TAG} ", (TAG.count(" ") + 1, None, False))
    made.make_automaton()
    return made


def scan_text(text: str | None, found_by) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive of one text."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.translate(_WORDS).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, "", None
    line = " " + b" ".join(words).decode("latin-1") + " "
    base, base_labels, labels, places, tagged = [], set(), set(), 0, False
    seen, at = 0, 0  # words that end before ``at``: places come in order of their ends, so each part of the line is counted once
    named: list[tuple[int, int, str]] = []  # (first word, end, label) of the places, for phrases that "and", "or" and "with" join
    for end, (length, label, is_base) in found_by.iter(line):
        seen, at = seen + line.count(" ", at, end), end
        if label is None:
            tagged = True
            continue
        places += 1
        labels.add(label)
        named.append((seen - length, seen, label))
        if is_base:
            base.append(seen - length)
            base_labels.add(label)
    parsed = []
    if tagged:
        parsed = [p for m in _TAGGED.finditer(data.lower()) if (p := to_postfix(m[1].decode("utf-8", "replace")))]
    if len(named) > 1:
        parsed += joined_phrases(named, words)
    free = None
    for p in parsed:
        named, permissive = evaluate(p)
        labels |= named
        free = permissive if free is None else free and permissive
    score = 1 - 2.0 ** -(places + 2 * len(parsed))
    first, last = (min(base), max(base)) if base else (None, None)
    return len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, "; ".join(map(" ".join, parsed)), free


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, further: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id and what ``scan_text`` gives. One pass over whole texts, no shuffle."""
    base, further = BASE_PHRASES if base is None else base, FURTHER_PHRASES if further is None else further
    phrases = (*((p, v, True) for p, v in base.items()), *((p, v, False) for p, v in further.items() if p not in base))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        found_by = automaton(phrases)
        for batch in batches:
            if batch.num_rows:
                yield [batch.column(0), *zip(*(scan_text(t, found_by) for t in batch.column(1).to_pylist()))]

    return c.map_batches(
        c.pick(docs, "doc_id", "text"), work,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean",
    )
