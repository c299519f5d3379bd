"""The signature rules of license scans.

A pattern is a regular expression over lower-case words with one space between them, and holds one <word>, its
keyword: only texts that have the keyword are looked at, and only around it.  Names of licenses give three rules each
(a tag, a notice, the bare name); wordings give one.  Patterns span at most REACH words on either side of the keyword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Words before and behind a keyword that a pattern may look at.
REACH = 24

# The phrases that every scan reports, and their labels.
BASE = (("cc-by", "<cc> by"), ("gpl", "<general> public license"), ("reserved", "all rights <reserved>"))

_L = "licen[sc]e"
_V = "(?: version| v)?"

#: (label, words of its identifier, its name in prose); the first word of an identifier is its keyword.
NAMES = (
    ("0bsd", "0bsd", rf"zero clause <bsd>(?: {_L})?"),
    ("aal", "aal", rf"<attribution> assurance {_L}"),
    ("afl-3.0", "afl 3 0", rf"<academic> free {_L}{_V}(?: 3 0)?"),
    ("agpl-1.0", "agpl 1 0(?: only| or later)?", rf"<affero> general public {_L}{_V} 1(?: 0)?"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", rf"(?:gnu )?<affero> general public {_L}(?:{_V} 3(?: 0)?)?"),
    ("apache-1.1", "apache 1 1", rf"<apache> software {_L}{_V} 1 1"),
    ("apache-2.0", "apache 2 0", rf"<apache>(?: software)? {_L}{_V} 2(?: 0)?"),
    ("apsl-2.0", "apsl 2 0", rf"<apple> public source {_L}(?:{_V} 2 0)?"),
    ("artistic-1.0", "artistic 1 0(?: perl| cl8)?", rf"<artistic> {_L}{_V} 1(?: 0)?"),
    ("artistic-2.0", "artistic 2 0", rf"<artistic> {_L}{_V} 2(?: 0)?"),
    ("beerware", "beerware", rf"<beerware> {_L}"),
    ("bsd-1-clause", "bsd 1 clause", rf"(?:1|one) clause <bsd>(?: {_L})?"),
    ("bsd-2-clause", "bsd 2 clause", rf"(?:2 clause|two clause|simplified|freebsd) <bsd>(?: {_L})?"),
    ("bsd-3-clause", "bsd 3 clause", rf"(?:3 clause|three clause|new|modified|revised) <bsd>(?: {_L})?"),
    ("bsd-4-clause", "bsd 4 clause", rf"(?:4 clause|four clause|original|old) <bsd>(?: {_L})?"),
    ("bsl-1.0", "bsl 1 0", rf"<boost> software {_L}(?:{_V} 1(?: 0)?)?"),
    ("busl-1.1", "busl 1 1", rf"<business> source {_L}(?: 1 1)?"),
    ("cc-by-1.0", "cc by 1 0", "creative <commons> attribution 1 0(?: generic)?"),
    ("cc-by-2.0", "cc by 2 0", "creative <commons> attribution 2 0(?: generic)?"),
    ("cc-by-2.5", "cc by 2 5", "creative <commons> attribution 2 5(?: generic)?"),
    ("cc-by-3.0", "cc by 3 0", "creative <commons> attribution 3 0(?: unported)?"),
    ("cc-by-4.0", "cc by 4 0", "creative <commons> attribution 4 0(?: international)?"),
    ("cc-by-sa-2.0", "cc by sa 2 0", "creative <commons> attribution share ?alike 2 0(?: generic)?"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "creative <commons> attribution share ?alike 3 0(?: unported)?"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "creative <commons> attribution share ?alike 4 0(?: international)?"),
    ("cc-by-nc-3.0", "cc by nc 3 0", "creative <commons> attribution non ?commercial 3 0(?: unported)?"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "creative <commons> attribution non ?commercial 4 0(?: international)?"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "creative <commons> attribution non ?commercial share ?alike 4 0(?: international)?"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "creative <commons> attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "creative <commons> attribution no ?deriv(?:ative)?s 4 0(?: international)?"),
    ("cc-by-nc", "cc by nc", "creative <commons> attribution non ?commercial"),
    ("cc-by-nc-nd", "cc by nc nd", "creative <commons> attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "cc by nc sa", "creative <commons> attribution non ?commercial share ?alike"),
    ("cc-by-nd", "cc by nd", "creative <commons> attribution no ?deriv(?:ative)?s"),
    ("cc-by-sa", "cc by sa", "creative <commons> attribution share ?alike"),
    ("cc0-1.0", "cc0(?: 1 0)?", "creative <commons> (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    ("cddl-1.0", "cddl 1 0", rf"common development and <distribution> {_L}(?:{_V} 1 0)?"),
    ("cddl-1.1", "cddl 1 1", rf"common development and <distribution> {_L}{_V} 1 1"),
    ("cecill-2.1", "cecill 2 1", rf"<cecill> free software {_L} agreement(?:{_V} 2 1)?"),
    ("cecill-b", "cecill b", rf"<cecill> b(?: free software)? {_L}"),
    ("cecill-c", "cecill c", rf"<cecill> c(?: free software)? {_L}"),
    ("commons-clause", "commons clause", rf"<commons> clause {_L} condition"),
    ("cpl-1.0", "cpl 1 0", rf"<common> public {_L}(?:{_V} 1 0)?"),
    ("curl", "curl", rf"<curl> {_L}"),
    ("ecl-2.0", "ecl 2 0", rf"<educational> community {_L}(?:{_V} 2 0)?"),
    ("efl-2.0", "efl 2 0", rf"<eiffel> forum {_L}(?:{_V} 2)?"),
    ("elastic-2.0", "elastic 2 0", rf"<elastic> {_L}(?:{_V} 2(?: 0)?)?"),
    ("epl-1.0", "epl 1 0", rf"<eclipse> public {_L}{_V} 1(?: 0)?"),
    ("epl-2.0", "epl 2 0", rf"<eclipse> public {_L}{_V} 2(?: 0)?"),
    ("etalab-2.0", "etalab 2 0", "licence ouverte <etalab>(?: 2 0)?"),
    ("eupl-1.1", "eupl 1 1", rf"european <union> public {_L}{_V} 1 1"),
    ("eupl-1.2", "eupl 1 2", rf"european <union> public {_L}(?:{_V} 1 2)?"),
    ("gfdl-1.1", "gfdl 1 1(?: only| or later)?", rf"free <documentation> {_L}{_V} 1 1"),
    ("gfdl-1.2", "gfdl 1 2(?: only| or later)?", rf"free <documentation> {_L}{_V} 1 2"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", rf"(?:gnu )?free <documentation> {_L}(?:{_V} 1 3)?"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", rf"(?:gnu )?<general> public {_L}{_V} 1(?: 0)?"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", rf"(?:gnu )?<general> public {_L}{_V} 2(?: 0)?"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", rf"(?:gnu )?<general> public {_L}{_V} 3(?: 0)?"),
    ("hpnd", "hpnd", "historical <permission> notice and disclaimer"),
    ("icu", "icu", rf"<icu> {_L}"),
    ("ijg", "ijg", rf"independent <jpeg> group {_L}"),
    ("imagemagick", "imagemagick", rf"<imagemagick> {_L}"),
    ("ipl-1.0", "ipl 1 0", rf"<ibm> public {_L}(?:{_V} 1 0)?"),
    ("isc", "isc", rf"<isc> {_L}"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", rf"(?:gnu )?<library> general public {_L}(?:{_V} 2(?: 0)?)?"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", rf"(?:gnu )?<lesser> general public {_L}{_V} 2 1"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", rf"(?:gnu )?<lesser> general public {_L}{_V} 3(?: 0)?"),
    ("libpng", "libpng(?: 2 0)?", rf"<libpng> {_L}"),
    ("lppl-1.3c", "lppl 1 3c", rf"<latex> project public {_L}(?:{_V} 1 3c?)?"),
    ("mit", "mit", rf"<mit>(?: x11)? {_L}"),
    ("mit-0", "mit 0", rf"<mit> no attribution(?: {_L})?"),
    ("mpl-1.0", "mpl 1 0", rf"<mozilla> public {_L}{_V} 1 0"),
    ("mpl-1.1", "mpl 1 1", rf"<mozilla> public {_L}{_V} 1 1"),
    ("mpl-2.0", "mpl 2 0", rf"<mozilla> public {_L}{_V} 2(?: 0)?"),
    ("ms-pl", "ms pl", rf"<microsoft> public {_L}"),
    ("ms-rl", "ms rl", rf"<microsoft> reciprocal {_L}"),
    ("mulanpsl-2.0", "mulanpsl 2 0", rf"<mulan> psl(?: v2| 2 0)?"),
    ("nasa-1.3", "nasa 1 3", rf"<nasa> open source agreement(?: 1 3)?"),
    ("ncsa", "ncsa", rf"(?:university of illinois )?<ncsa> open source {_L}"),
    ("odbl-1.0", "odbl 1 0", rf"open <database> {_L}(?:{_V} 1 0)?"),
    ("odc-by-1.0", "odc by 1 0", rf"open data <commons> attribution {_L}(?:{_V} 1 0)?"),
    ("ofl-1.1", "ofl 1 1", rf"(?:sil )?open <font> {_L}(?:{_V} 1 1)?"),
    ("ogl-uk-3.0", "ogl uk 3 0", rf"open <government> licen[sc]e(?:{_V} 3 0)?"),
    ("openssl", "openssl", rf"<openssl> {_L}"),
    ("osl-3.0", "osl 3 0", rf"open <software> {_L}{_V} 3 0"),
    ("pddl-1.0", "pddl 1 0", rf"public <domain> dedication and {_L}(?: 1 0)?"),
    ("php-3.01", "php 3 01", rf"<php> {_L}{_V} 3 01"),
    ("polyform-noncommercial-1.0.0", "polyform noncommercial 1 0 0", rf"<polyform> noncommercial {_L}(?: 1 0 0)?"),
    ("postgresql", "postgresql", rf"<postgresql> {_L}"),
    ("psf-2.0", "psf 2 0", rf"<python> software foundation {_L}(?:{_V} 2)?"),
    ("qpl-1.0", "qpl 1 0", rf"<q> public {_L}(?:{_V} 1 0)?"),
    ("rpl-1.5", "rpl 1 5", rf"<reciprocal> public {_L}(?: 1 5)?"),
    ("ruby", "ruby", rf"<ruby> {_L}"),
    ("sissl", "sissl", rf"sun industry <standards> source {_L}"),
    ("sleepycat", "sleepycat", rf"<sleepycat> {_L}"),
    ("sspl-1.0", "sspl 1 0", rf"server <side> public {_L}(?:{_V} 1)?"),
    ("tcl", "tcl", rf"<tcl> tk {_L}"),
    ("unicode-dfs-2016", "unicode dfs 2016", rf"<unicode> {_L} agreement"),
    ("unlicense", "unlicense", "<unlicense>"),
    ("upl-1.0", "upl 1 0", rf"<universal> permissive {_L}(?:{_V} 1 0)?"),
    ("vim", "vim", rf"<vim> {_L}"),
    ("w3c", "w3c", rf"<w3c> software(?: notice and)? {_L}"),
    ("watcom-1.0", "watcom 1 0", rf"sybase open <watcom> public {_L}(?: 1 0)?"),
    ("wtfpl", "wtfpl", "do what the <fuck> you want to public license"),
    ("x11", "x11", rf"<x11> {_L}"),
    ("zlib", "zlib", rf"<zlib>(?: libpng)? {_L}"),
    ("zpl-2.1", "zpl 2 1", rf"<zope> public {_L}(?:{_V} 2 1)?"),
)

#: (label, weight, pattern) of wordings that say a license without its name, or say that rights are kept.
WORDINGS = (
    ("apache-2.0", 0.9, "you may not use this file except in <compliance> with the license"),
    ("apache-2.0", 0.9, "(?:www )?<apache> org licenses license 2 0(?: txt| html)?"),
    ("mit", 0.9, "permission is hereby granted free of <charge> to any person obtaining a copy(?: of this software)?"),
    ("mit", 0.7, "the above copyright notice and this <permission> notice shall be included in all copies"),
    ("mit", 0.9, "opensource org licenses <mit>(?: license)?"),
    ("bsd", 0.9, "<redistribution> and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 0.9, "neither the name of (?:[^ ]+ ){1,8}nor the names of (?:its|the) <contributors> may be used to endorse"),
    ("bsd-4-clause", 0.9, "all <advertising> materials mentioning features or use of this software must display"),
    ("isc", 0.9, "permission to use copy modify and or distribute this software for any purpose with or without <fee> is hereby granted"),
    ("zlib", 0.8, "altered source versions must be plainly marked as such and must not be <misrepresented> as being the original software"),
    ("json", 0.9, "the software shall be used for good not <evil>"),
    ("unlicense", 0.9, "free and unencumbered software released into the public <domain>"),
    ("public-domain", 0.6, "(?:released|placed|dedicated|is) (?:in|into|to) the public <domain>"),
    ("public-domain", 0.6, "no rights <reserved>"),
    ("gpl", 0.9, "you can <redistribute> it and or modify it under the terms of the gnu"),
    ("gpl", 0.7, "along with this program if not see(?: https?)?(?: www)? <gnu> org licenses"),
    ("gpl", 0.7, "free software <foundation> either version [123] of the license"),
    ("gpl-2.0", 0.8, "<gplv2>"),
    ("gpl-3.0", 0.8, "<gplv3>"),
    ("gpl-2.0", 0.7, "gnu <gpl> (?:version |v)?2"),
    ("gpl-3.0", 0.7, "gnu <gpl> (?:version |v)?3"),
    ("lgpl", 0.7, rf"<lesser> general public {_L}"),
    ("lgpl-3.0", 0.8, "<lgplv3>"),
    ("agpl-3.0", 0.8, "<agplv3>"),
    ("mpl-2.0", 0.9, "subject to the terms of the <mozilla> public license"),
    ("mpl-2.0", 0.9, "if a copy of the <mpl> was not distributed with this file"),
    ("wtfpl", 0.9, "you just do what the <fuck> you want to"),
    ("beerware", 0.8, "you can buy me a <beer> in return"),
    ("cc0-1.0", 0.8, "creativecommons org publicdomain <zero>(?: 1 0)?"),
    ("cc-by", 0.8, "<creativecommons> org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", 0.8, "<creativecommons> org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nc", 0.8, "<creativecommons> org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nd", 0.8, "<creativecommons> org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", 0.8, "<creativecommons> org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", 0.8, "<creativecommons> org licenses by nc nd(?: [1-4] [05])?"),
    ("creative-commons", 0.5, rf"creative <commons>(?: attribution)?(?: {_L})?"),
    ("copyright", 0.4, "<copyright>(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("proprietary", 0.7, "confidential and <proprietary>"),
    ("proprietary", 0.7, "<proprietary> and confidential"),
    ("proprietary", 0.7, "unauthorized <copying> of (?:this|any) [^ ]+ (?:[^ ]+ ){0,6}is strictly prohibited"),
    ("proprietary", 0.6, "may not be (?:[^ ]+ ){0,6}<redistributed> without (?:[^ ]+ ){0,4}permission"),
    ("proprietary", 0.6, "no part of this (?:[^ ]+ ){1,3}may be <reproduced>"),
    ("non-commercial", 0.6, "for (?:personal and |educational and )?non <commercial> use only"),
    ("evaluation", 0.6, "for <evaluation> purposes only"),
)

_NOTICE = "(?:licensed|released|distributed|available|published|provided|shared) under (?:the )?(?:terms of )?(?:the |an? )?"


@dataclass(frozen=True)
class Rule:
    """A signature; the earlier of two rules with equal priority and length wins."""

    order: int
    label: str
    priority: int
    weight: float
    keyword: str
    before: str
    after: str
    base: bool = False


def _split(pattern: str) -> tuple[str, str, str]:
    """Keyword, and the parts around it as patterns over words with a space on either side."""
    before, keyword, after = re.fullmatch(r"(.*)<([^<> ]+)>(.*)", pattern).groups()
    return keyword, f" {before}$", f"^{after} "


def _tagged(identifier: str) -> str:
    head, *rest = re.match(r"([^ (]+)(.*)", identifier).groups()
    return f"<{head}>{''.join(rest)}"


def rules() -> list[Rule]:
    """All rules in order: tags, notices, wordings, bare names, and the phrases that are always reported."""
    made = [(label, 4, 0.98, f"spdx license identifier {_tagged(words)}") for label, words, _ in NAMES]
    made += [(label, 3, 0.95, f"{_NOTICE}{name}") for label, _, name in NAMES]
    made += [(label, 3, 0.95, f"{_NOTICE}{_tagged(words)}") for label, words, _ in NAMES]
    made += [(label, 2, weight, pattern) for label, weight, pattern in WORDINGS]
    made += [(label, 2, 0.7, name) for label, _, name in NAMES]
    made += [(label, 1, 0.6, pattern) for label, pattern in BASE]
    first_base = len(made) - len(BASE)
    return [Rule(i, label, priority, weight, *_split(pattern), i >= first_base) for i, (label, priority, weight, pattern) in enumerate(made)]
