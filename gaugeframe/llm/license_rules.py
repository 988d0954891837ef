"""Signatures of licenses: what the license scan looks for.

A signature is (label, kind, keyword, pattern).  Texts are matched as words with
single spaces between: A-Z lower-cased, every other character but digits,
letters and non-ASCII ones gone, so ``GPL-3.0-or-later`` reads
``gpl 3 0 or later``.  A pattern covers whole words; it is tried only on texts
that have the words of a keyword in a row (``a|b``: of one of them).  The labels are those that are usual for
the licenses, in lower case, without a minor version of 0.
"""

from __future__ import annotations

#: Kinds of signatures by falling priority, with the confidence of a match.
KINDS = {"tag": 1.0, "text": 0.97, "notice": 0.95, "name": 0.9, "url": 0.85, "family": 0.6, "hint": 0.3}

L = "licen[sc]e"
V = "(?:version |ver |v )?v?"
UNDER = f"(?:licen[sc]ed|released|available|distributed|published|provided|covered|offered|is|are|made available) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the |a )?)?"
SPDX = f"spdx {L} identifier"

#: Phrases of the fixed part: their words in a row, and the label (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

SIGNATURES = (
    # MIT and its kin
    ("mit", "tag", "spdx", f"{SPDX} mit"),
    ("mit", "text", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "text", "above copyright notice", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "notice", "mit", f"{UNDER}mit(?: x11)? {L}"),
    ("mit", "name", "mit", f"(?:the )?mit {L}(?: mit)?"),
    ("mit", "name", "mit", f"mit style {L}|{L} mit"),
    ("mit", "name", "expat", f"(?:the )?expat {L}"),
    ("mit", "url", "opensource", f"opensource org {L}s mit(?: {L}(?: php)?)?"),
    ("mit", "url", "mit", "choosealicense com licenses mit"),
    ("mit-0", "tag", "spdx", f"{SPDX} mit 0"),
    ("mit-0", "name", "mit", f"mit no attribution(?: {L})?|mit 0(?: {L})?"),
    ("x11", "tag", "spdx", f"{SPDX} x11"),
    ("x11", "name", "x11", f"(?:the )?x11 {L}"),
    ("x11", "text", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "tag", "spdx", f"{SPDX} isc"),
    ("isc", "text", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", "notice", "isc", f"{UNDER}isc {L}"),
    ("isc", "name", "isc", f"(?:the )?isc {L}"),
    ("isc", "url", "opensource", f"opensource org {L}s isc(?: {L}(?: txt)?)?"),
    ("0bsd", "tag", "spdx", f"{SPDX} 0bsd"),
    ("0bsd", "name", "0bsd", f"0bsd(?: {L})?"),
    ("0bsd", "name", "clause|free public", f"(?:bsd zero clause|zero clause bsd|free public) {L}(?: 1 0 0)?"),
    # BSD
    ("bsd-2-clause", "tag", "spdx", f"{SPDX} bsd 2 clause"),
    ("bsd-2-clause", "notice", "bsd|freebsd", f"{UNDER}(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) {L}"),
    ("bsd-2-clause", "name", "bsd", f"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: {L})?"),
    ("bsd-2-clause", "name", "freebsd", f"freebsd {L}"),
    ("bsd-2-clause", "url", "opensource", f"opensource org {L}s bsd 2 clause"),
    ("bsd-3-clause", "tag", "spdx", f"{SPDX} bsd 3 clause(?: clear)?"),
    ("bsd-3-clause", "text", "endorse or promote", "neither the names? of .{1,120}? (?:may|shall) be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "notice", "bsd", f"{UNDER}(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) {L}"),
    ("bsd-3-clause", "name", "bsd", f"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: {L})?"),
    ("bsd-3-clause", "url", "opensource", f"opensource org {L}s bsd 3 clause"),
    ("bsd-4-clause", "tag", "spdx", f"{SPDX} bsd 4 clause(?: uc)?"),
    ("bsd-4-clause", "text", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause", "name", "bsd", f"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: {L})?"),
    ("bsd", "text", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "notice", "bsd", f"{UNDER}bsd(?: style)? {L}"),
    ("bsd", "family", "bsd|berkeley software", f"(?:the )?(?:berkeley software distribution|bsd)(?: style)? {L}"),
    ("bsd", "url", "opensource", f"opensource org {L}s bsd {L}(?: php)?"),
    # Apache
    ("apache-2", "tag", "spdx", f"{SPDX} apache 2 0"),
    ("apache-2", "text", "you may not use this file", f"licensed under the apache {L} version 2 0 the {L} you may not use this file except in compliance with the {L}"),
    ("apache-2", "text", "apache", f"apache {L} version 2 0 january 2004"),
    ("apache-2", "notice", "apache", f"{UNDER}apache(?: software)?(?: {L})? {V}2(?: 0)?(?: {L})?"),
    ("apache-2", "name", "apache", f"(?:the )?apache(?: software(?: foundation)?)?(?: public)? {L} (?:asl )?{V}2(?: 0)?"),
    ("apache-2", "name", "apache", f"apache {V}2(?: 0)?(?: {L})?"),
    ("apache-2", "name", "asl", "asl (?:version |v )?v?2 0"),
    ("apache-2", "url", "apache", f"apache org {L}s {L} 2 0(?: txt| html)?"),
    ("apache-2", "url", "opensource", f"opensource org {L}s apache 2 0"),
    ("apache-1.1", "tag", "spdx", f"{SPDX} apache 1 1"),
    ("apache-1.1", "name", "apache", f"apache(?: software)? {L} {V}1 1"),
    ("apache-1", "tag", "spdx", f"{SPDX} apache 1 0"),
    ("apache-1", "name", "apache", f"apache(?: software)? {L} {V}1 0"),
    ("apache", "family", "apache", f"(?:the )?apache(?: software(?: foundation)?)? {L}"),
    # GNU
    ("gpl-1", "tag", "spdx", f"{SPDX} gpl 1 0(?: only| or later)?"),
    ("gpl-1", "name", "gnu", f"gnu general public {L} (?:gpl )?{V}1(?: 0)?"),
    ("gpl-2", "tag", "spdx", f"{SPDX} gpl 2 0(?: only| or later)?(?: with [a-z0-9 ]{{3,40}}exception)?"),
    ("gpl-2", "text", "general public license", f"gnu general public {L} version 2 june 1991"),
    ("gpl-2", "text", "free software", f"under the terms of the gnu general public {L} as published by the free software foundation either version 2(?: of the {L})? or (?:at your option )?any later version"),
    ("gpl-2", "notice", "gpl|general public", f"{UNDER}(?:gnu )?(?:general public {L}|gpl)(?: gpl)? {V}2(?: 0)?(?: {L}| only| or later)?"),
    ("gpl-2", "name", "general public", f"(?:gnu )?general public {L} (?:gpl )?{V}2(?: 0)?"),
    ("gpl-2", "name", "gpl", f"(?:gnu )?gpl {V}2(?: 0)?(?: {L}| only| or later)?"),
    ("gpl-2", "name", "gplv2", f"(?:gnu )?gplv2(?: 0)?(?: {L})?"),
    ("gpl-2", "name", "gpl2", f"(?:gnu )?gpl2(?: {L})?"),
    ("gpl-2", "url", "gnu", f"gnu org (?:old )?{L}s (?:old {L}s )?gpl 2 0(?: [a-z]{{2}})?(?: html| txt)?"),
    ("gpl-2", "url", "opensource", f"opensource org {L}s gpl 2 0"),
    ("gpl-3", "tag", "spdx", f"{SPDX} gpl 3 0(?: only| or later)?(?: with [a-z0-9 ]{{3,40}}exception)?"),
    ("gpl-3", "text", "general public license", f"gnu general public {L} version 3 29 june 2007"),
    ("gpl-3", "text", "free software", f"under the terms of the gnu general public {L} as published by the free software foundation either version 3(?: of the {L})? or (?:at your option )?any later version"),
    ("gpl-3", "notice", "gpl|general public", f"{UNDER}(?:gnu )?(?:general public {L}|gpl)(?: gpl)? {V}3(?: 0)?(?: {L}| only| or later)?"),
    ("gpl-3", "name", "general public", f"(?:gnu )?general public {L} (?:gpl )?{V}3(?: 0)?"),
    ("gpl-3", "name", "gpl", f"(?:gnu )?gpl {V}3(?: 0)?(?: {L}| only| or later)?"),
    ("gpl-3", "name", "gplv3", f"(?:gnu )?gplv3(?: 0)?(?: {L})?"),
    ("gpl-3", "name", "gpl3", f"(?:gnu )?gpl3(?: {L})?"),
    ("gpl-3", "url", "gnu", f"gnu org {L}s gpl 3 0(?: [a-z]{{2}})?(?: html| txt)?"),
    ("gpl-3", "url", "opensource", f"opensource org {L}s gpl 3 0"),
    ("gpl", "notice", "gpl", f"{UNDER}(?:gnu )?gpl(?: {L})?"),
    ("gpl", "text", "general public license", f"you should have received a copy of the gnu general public {L} along with this (?:program|library|file|package)"),
    ("gpl", "family", "gnu", f"gnu (?:general public {L}|gpl)(?: gpl)?"),
    ("gpl", "url", "gnu", f"gnu org {L}s gpl(?: html| txt)?|gnu org copyleft gpl(?: html)?"),
    ("lgpl-2", "tag", "spdx", f"{SPDX} lgpl 2 0(?: only| or later)?"),
    ("lgpl-2", "name", "library general", f"(?:gnu )?library general public {L} (?:lgpl )?{V}2(?: 0)?"),
    ("lgpl-2.1", "tag", "spdx", f"{SPDX} lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.1", "text", "lesser general", f"gnu lesser general public {L} version 2 1 february 1999"),
    ("lgpl-2.1", "text", "lesser general", f"under the terms of the gnu lesser general public {L} as published by the free software foundation either version 2 1(?: of the {L})? or (?:at your option )?any later version"),
    ("lgpl-2.1", "notice", "lesser general", f"{UNDER}(?:gnu )?lesser general public {L}(?: lgpl)? {V}2 1"),
    ("lgpl-2.1", "name", "lesser general", f"(?:gnu )?lesser general public {L} (?:lgpl )?{V}2 1"),
    ("lgpl-2.1", "name", "lgpl", f"(?:gnu )?lgpl {V}2 1(?: {L}| only| or later)?"),
    ("lgpl-2.1", "name", "lgplv2", f"(?:gnu )?lgplv2 1(?: {L})?"),
    ("lgpl-2.1", "url", "lgpl", f"(?:gnu|opensource) org (?:old )?{L}s (?:old {L}s )?lgpl 2 1(?: html| txt)?"),
    ("lgpl-3", "tag", "spdx", f"{SPDX} lgpl 3 0(?: only| or later)?"),
    ("lgpl-3", "text", "lesser general", f"gnu lesser general public {L} version 3 29 june 2007"),
    ("lgpl-3", "notice", "lesser general", f"{UNDER}(?:gnu )?lesser general public {L}(?: lgpl)? {V}3(?: 0)?"),
    ("lgpl-3", "name", "lesser general", f"(?:gnu )?lesser general public {L} (?:lgpl )?{V}3(?: 0)?"),
    ("lgpl-3", "name", "lgpl", f"(?:gnu )?lgpl {V}3(?: 0)?(?: {L}| only| or later)?"),
    ("lgpl-3", "name", "lgplv3", f"(?:gnu )?lgplv3(?: {L})?"),
    ("lgpl-3", "url", "lgpl", f"(?:gnu|opensource) org {L}s lgpl 3 0(?: html| txt)?"),
    ("lgpl", "family", "lgpl", f"(?:gnu )?lgpl(?: {L})?"),
    ("lgpl", "family", "general public", f"gnu (?:lesser|library) general public {L}(?: lgpl)?"),
    ("agpl-3", "tag", "spdx", f"{SPDX} agpl 3 0(?: only| or later)?"),
    ("agpl-3", "text", "affero", f"gnu affero general public {L} version 3 19 november 2007"),
    ("agpl-3", "text", "affero", f"under the terms of the gnu affero general public {L} as published by the free software foundation either version 3(?: of the {L})? or (?:at your option )?any later version"),
    ("agpl-3", "notice", "affero", f"{UNDER}(?:gnu )?affero general public {L}(?: agpl)? {V}3(?: 0)?"),
    ("agpl-3", "name", "affero", f"(?:gnu )?affero (?:general public {L}|gpl) (?:agpl )?{V}3(?: 0)?"),
    ("agpl-3", "name", "agpl", f"(?:gnu )?agpl {V}3(?: 0)?(?: {L}| only| or later)?"),
    ("agpl-3", "name", "agplv3", f"(?:gnu )?agplv3(?: {L})?"),
    ("agpl-3", "url", "agpl", f"(?:gnu|opensource) org {L}s agpl(?: 3 0)?(?: html| txt)?"),
    ("agpl", "family", "affero", f"(?:gnu )?affero (?:general public {L}|gpl)"),
    ("agpl", "family", "agpl", f"(?:gnu )?agpl {L}"),
    ("gfdl-1.2", "tag", "spdx", f"{SPDX} gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.2", "name", "free documentation", f"(?:gnu )?free documentation {L} (?:gfdl )?{V}1 2"),
    ("gfdl-1.3", "tag", "spdx", f"{SPDX} gfdl 1 3(?: only| or later)?"),
    ("gfdl-1.3", "name", "free documentation", f"(?:gnu )?free documentation {L} (?:gfdl )?{V}1 3"),
    ("gfdl", "family", "free documentation", f"(?:gnu )?free documentation {L}"),
    ("gfdl", "family", "gfdl", f"gfdl(?: {L})?"),
    # Mozilla, Eclipse, and other licenses of files
    ("mpl-1.1", "tag", "spdx", f"{SPDX} mpl 1 1"),
    ("mpl-1.1", "notice", "mozilla", f"subject to the mozilla public {L} version 1 1"),
    ("mpl-1.1", "name", "mozilla", f"mozilla public {L} (?:mpl )?{V}1 1"),
    ("mpl-2", "tag", "spdx", f"{SPDX} mpl 2 0(?: no copyleft exception)?"),
    ("mpl-2", "text", "mozilla", f"this source code form is subject to the terms of the mozilla public {L} v 2 0"),
    ("mpl-2", "notice", "mozilla", f"{UNDER}mozilla public {L}(?: mpl)? {V}2(?: 0)?"),
    ("mpl-2", "name", "mozilla", f"mozilla public {L} (?:mpl )?{V}2(?: 0)?"),
    ("mpl-2", "name", "mpl", f"mpl {V}2(?: 0)?(?: {L})?"),
    ("mpl-2", "url", "mozilla", "mozilla org mpl 2 0"),
    ("mpl", "family", "mozilla", f"mozilla public {L}"),
    ("epl-1", "tag", "spdx", f"{SPDX} epl 1 0"),
    ("epl-1", "notice", "eclipse", f"{UNDER}eclipse public {L} {V}1(?: 0)?"),
    ("epl-1", "name", "eclipse", f"eclipse public {L} (?:epl )?{V}1(?: 0)?"),
    ("epl-1", "url", "eclipse", "eclipse org legal epl v10(?: html)?"),
    ("epl-2", "tag", "spdx", f"{SPDX} epl 2 0"),
    ("epl-2", "notice", "eclipse", f"{UNDER}eclipse public {L} {V}2(?: 0)?"),
    ("epl-2", "name", "eclipse", f"eclipse public {L} (?:epl )?{V}2(?: 0)?"),
    ("epl-2", "url", "eclipse", "eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("epl", "family", "eclipse", f"eclipse public {L}"),
    ("edl-1", "name", "eclipse", f"eclipse distribution {L}(?: {V}1(?: 0)?)?"),
    ("cddl-1", "tag", "spdx", f"{SPDX} cddl 1 0"),
    ("cddl-1", "name", "cddl", f"cddl {V}1 0"),
    ("cddl-1.1", "tag", "spdx", f"{SPDX} cddl 1 1"),
    ("cddl-1.1", "name", "cddl", f"cddl {V}1 1"),
    ("cddl", "family", "common development", f"common development and distribution {L}(?: cddl)?(?: {V}1(?: [01])?)?"),
    ("cpl-1", "tag", "spdx", f"{SPDX} cpl 1 0"),
    ("cpl-1", "name", "common public", f"common public {L}(?: {V}1 0)?"),
    ("cpal-1", "tag", "spdx", f"{SPDX} cpal 1 0"),
    ("cpal-1", "name", "common public", f"common public attribution {L}(?: {V}1 0)?"),
    ("epl-erlang", "name", "erlang", f"erlang public {L}"),
    ("eupl-1.1", "tag", "spdx", f"{SPDX} eupl 1 1"),
    ("eupl-1.1", "name", "eupl", f"(?:european union public {L} )?eupl {V}1 1"),
    ("eupl-1.2", "tag", "spdx", f"{SPDX} eupl 1 2"),
    ("eupl-1.2", "name", "eupl", f"(?:european union public {L} )?eupl {V}1 2"),
    ("eupl", "family", "european union", f"european union public {L}"),
    ("osl-3", "tag", "spdx", f"{SPDX} osl 3 0"),
    ("osl-3", "name", "open software", f"open software {L} (?:osl )?{V}3(?: 0)?"),
    ("osl", "family", "open software", f"open software {L}"),
    ("afl-3", "tag", "spdx", f"{SPDX} afl 3 0"),
    ("afl-3", "name", "academic free", f"academic free {L} (?:afl )?{V}3(?: 0)?"),
    ("afl", "family", "academic free", f"academic free {L}"),
    ("artistic-1", "tag", "spdx", f"{SPDX} artistic 1 0(?: perl| cl8)?"),
    ("artistic-1", "name", "artistic", f"artistic {L} {V}1(?: 0)?"),
    ("artistic-2", "tag", "spdx", f"{SPDX} artistic 2 0"),
    ("artistic-2", "name", "artistic", f"artistic {L} {V}2(?: 0)?"),
    ("artistic-2", "url", "artistic", f"opensource org {L}s artistic {L} 2 0"),
    ("artistic", "family", "artistic", f"(?:the )?artistic {L}"),
    ("perl", "notice", "perl", "(?:free software )?you (?:can|may) redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("bsl-1", "tag", "spdx", f"{SPDX} bsl 1 0"),
    ("bsl-1", "notice", "boost", f"(?:{UNDER}|subject to the )boost software {L}(?: version 1 0)?"),
    ("bsl-1", "name", "boost", f"boost software {L}(?: {V}1(?: 0)?)?"),
    ("bsl-1", "url", "boost", f"boost org {L} 1 0(?: txt)?"),
    ("busl-1.1", "tag", "spdx", f"{SPDX} busl 1 1"),
    ("busl-1.1", "name", "business source", f"business source {L}(?: {V}1 1)?"),
    ("sspl-1", "tag", "spdx", f"{SPDX} sspl 1 0"),
    ("sspl-1", "name", "server side", f"server side public {L}(?: {V}1(?: 0)?)?"),
    ("sspl-1", "name", "sspl", f"sspl(?: {V}1(?: 0)?)?"),
    ("elastic-2", "tag", "spdx", f"{SPDX} elastic 2 0"),
    ("elastic-2", "name", "elastic", f"elastic {L} {V}2(?: 0)?"),
    ("elastic", "family", "elastic", f"elastic {L}"),
    ("zlib", "tag", "spdx", f"{SPDX} zlib"),
    ("zlib", "text", "express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "notice", "zlib", f"{UNDER}zlib(?: libpng)? {L}"),
    ("zlib", "name", "zlib", f"zlib(?: libpng)? {L}"),
    ("libpng", "tag", "spdx", f"{SPDX} libpng(?: 2 0)?"),
    ("libpng", "name", "libpng|png reference", f"(?:png reference library|libpng) {L}(?: {V}[12](?: 0)?)?"),
    ("openssl", "tag", "spdx", f"{SPDX} openssl"),
    ("openssl", "name", "openssl", f"openssl {L}"),
    ("openssl", "text", "openssl", "this product includes software developed by the openssl project"),
    ("curl", "tag", "spdx", f"{SPDX} curl"),
    ("curl", "name", "curl", f"curl {L}"),
    ("ncsa", "tag", "spdx", f"{SPDX} ncsa"),
    ("ncsa", "name", "ncsa|university of illinois", f"(?:university of illinois )?(?:ncsa|university of illinois) open source {L}"),
    ("psf-2", "tag", "spdx", f"{SPDX} (?:psf 2 0|python 2 0(?: 1)?)"),
    ("psf-2", "name", "python software|psf", f"python software foundation {L}(?: {V}2(?: 0)?)?|psf {L}(?: agreement)?"),
    ("postgresql", "tag", "spdx", f"{SPDX} postgresql"),
    ("postgresql", "name", "postgresql", f"postgresql {L}"),
    ("php-3.01", "tag", "spdx", f"{SPDX} php 3 0 ?1"),
    ("php-3.01", "name", "php", f"php {L} {V}3 0 ?1"),
    ("php", "family", "php", f"php {L}"),
    ("ruby", "tag", "spdx", f"{SPDX} ruby"),
    ("ruby", "name", "ruby", f"ruby(?: s)? {L}"),
    ("vim", "tag", "spdx", f"{SPDX} vim"),
    ("vim", "name", "vim", f"vim {L}"),
    ("w3c", "tag", "spdx", f"{SPDX} w3c(?: [0-9]{{8}})?"),
    ("w3c", "name", "w3c", f"w3c software (?:and document )?(?:notice and )?{L}"),
    ("ms-pl", "tag", "spdx", f"{SPDX} ms pl"),
    ("ms-pl", "name", "microsoft", f"microsoft public {L}(?: ms pl)?"),
    ("ms-rl", "tag", "spdx", f"{SPDX} ms rl"),
    ("ms-rl", "name", "microsoft", f"microsoft reciprocal {L}(?: ms rl)?"),
    ("ofl-1.1", "tag", "spdx", f"{SPDX} ofl 1 1(?: rfn| no rfn)?"),
    ("ofl-1.1", "notice", "open font", f"{UNDER}(?:sil )?open font {L}(?: {V}1 1)?"),
    ("ofl-1.1", "name", "open font", f"(?:sil )?open font {L}(?: ofl)?(?: {V}1 1)?"),
    ("ofl-1.1", "url", "scripts sil org|openfontlicense", "(?:scripts sil org|openfontlicense org)(?: ofl)?"),
    ("lppl-1.3c", "tag", "spdx", f"{SPDX} lppl 1 3c"),
    ("lppl", "family", "latex", f"latex project public {L}(?: {V}1 3[abc]?)?"),
    ("cecill-2.1", "tag", "spdx", f"{SPDX} cecill 2 1"),
    ("cecill", "family", "cecill", f"cecill(?: [bc])?(?: free software)? {L}(?: agreement)?|licence cecill(?: [bc])?"),
    ("unlicense", "tag", "spdx", f"{SPDX} unlicense"),
    ("unlicense", "text", "public domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "name", "unlicense", "(?:under )?the unlicense|unlicense org"),
    ("wtfpl", "tag", "spdx", f"{SPDX} wtfpl"),
    ("wtfpl", "name", "wtfpl|do what", f"wtfpl(?: {L})?(?: {V}2)?|do what the f[a-z]{{3}} you want to public {L}"),
    ("beerware", "tag", "spdx", f"{SPDX} beerware"),
    ("beerware", "name", "beer|beerware", f"(?:the )?beer ?ware {L}"),
    ("blueoak-1", "tag", "spdx", f"{SPDX} blueoak 1 0 0"),
    ("blueoak-1", "name", "blue oak", f"blue oak model {L}(?: 1 0 0)?"),
    ("mulan-psl-2", "tag", "spdx", f"{SPDX} mulanpsl 2 0"),
    ("mulan-psl-2", "name", "mulan", f"mulan psl v2|mulan permissive software {L}(?: {V}2)?"),
    ("upl-1", "tag", "spdx", f"{SPDX} upl 1 0"),
    ("upl-1", "name", "universal permissive", f"universal permissive {L}(?: upl)?(?: {V}1(?: 0)?)?"),
    ("hippocratic", "name", "hippocratic", f"hippocratic {L}(?: {V}[0-9](?: [0-9])?)?"),
    ("json", "text", "not evil", "the software shall be used for good not evil"),
    # Creative Commons and data
    ("cc0", "tag", "spdx", f"{SPDX} cc0 1 0"),
    ("cc0", "text", "associated a work", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "name", "cc0", f"(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?(?: {L})?"),
    ("cc0", "name", "creative commons", "creative commons (?:zero|public domain dedication)(?: v?1 0)?"),
    ("cc0", "url", "creativecommons", "creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc-pdm", "name", "public domain mark", "(?:creative commons )?public domain mark(?: 1 0)?"),
    ("cc-pdm", "url", "creativecommons", "creativecommons org publicdomain mark(?: 1 0)?"),
    ("cc-by", "tag", "spdx", f"{SPDX} cc by [1-4] [05]"),
    ("cc-by", "name", "cc", f"cc by(?: {V}[1-4](?: [05])?)?(?: (?:international|unported|generic|deed|{L}))?(?! (?:nc|nd|sa))"),
    ("cc-by", "name", "creative commons", f"creative commons attribution(?: {V}[1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?{L})?(?! (?:non|no|share))"),
    ("cc-by", "url", "creativecommons", f"creativecommons org {L}s by(?: [1-4] [05])?(?! (?:nc|nd|sa))"),
    ("cc-by-sa", "tag", "spdx", f"{SPDX} cc by sa [1-4] [05]"),
    ("cc-by-sa", "name", "cc", f"cc by sa(?: {V}[1-4](?: [05])?)?(?: (?:international|unported|generic|deed|{L}))?"),
    ("cc-by-sa", "name", "creative commons", f"creative commons attribution share ?alike(?: {V}[1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?{L})?"),
    ("cc-by-sa", "url", "creativecommons", f"creativecommons org {L}s by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "tag", "spdx", f"{SPDX} cc by nc [1-4] [05]"),
    ("cc-by-nc", "name", "cc", f"cc by nc(?: {V}[1-4](?: [05])?)?(?: (?:international|unported|generic|deed|{L}))?(?! (?:nd|sa))"),
    ("cc-by-nc", "name", "creative commons", f"creative commons attribution non ?commercial(?: {V}[1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?{L})?(?! (?:no|share))"),
    ("cc-by-nc", "url", "creativecommons", f"creativecommons org {L}s by nc(?: [1-4] [05])?(?! (?:nd|sa))"),
    ("cc-by-nd", "tag", "spdx", f"{SPDX} cc by nd [1-4] [05]"),
    ("cc-by-nd", "name", "cc", f"cc by nd(?: {V}[1-4](?: [05])?)?(?: (?:international|unported|generic|deed|{L}))?"),
    ("cc-by-nd", "name", "creative commons", f"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: {V}[1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?{L})?"),
    ("cc-by-nd", "url", "creativecommons", f"creativecommons org {L}s by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "tag", "spdx", f"{SPDX} cc by nc sa [1-4] [05]"),
    ("cc-by-nc-sa", "name", "cc", f"cc by nc sa(?: {V}[1-4](?: [05])?)?(?: (?:international|unported|generic|deed|{L}))?"),
    ("cc-by-nc-sa", "name", "creative commons", f"creative commons attribution non ?commercial share ?alike(?: {V}[1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?{L})?"),
    ("cc-by-nc-sa", "url", "creativecommons", f"creativecommons org {L}s by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "tag", "spdx", f"{SPDX} cc by nc nd [1-4] [05]"),
    ("cc-by-nc-nd", "name", "cc", f"cc by nc nd(?: {V}[1-4](?: [05])?)?(?: (?:international|unported|generic|deed|{L}))?"),
    ("cc-by-nc-nd", "name", "creative commons", f"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: {V}[1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?{L})?"),
    ("cc-by-nc-nd", "url", "creativecommons", f"creativecommons org {L}s by nc nd(?: [1-4] [05])?"),
    ("cc", "family", "creative commons", f"(?:a |the )?creative commons {L}"),
    ("odbl-1", "tag", "spdx", f"{SPDX} odbl 1 0"),
    ("odbl-1", "name", "open database", f"(?:open data commons )?open database {L}(?: odbl)?(?: {V}1 0)?"),
    ("odbl-1", "url", "opendatacommons", f"opendatacommons org {L}s odbl(?: 1 0)?"),
    ("odc-by-1", "tag", "spdx", f"{SPDX} odc by 1 0"),
    ("odc-by-1", "name", "open data commons", f"open data commons attribution {L}(?: odc by)?(?: {V}1 0)?"),
    ("odc-by-1", "url", "opendatacommons", f"opendatacommons org {L}s by(?: 1 0)?"),
    ("pddl-1", "tag", "spdx", f"{SPDX} pddl 1 0"),
    ("pddl-1", "name", "public domain dedication", f"(?:open data commons )?public domain dedication and {L}(?: pddl)?"),
    ("cdla-permissive-2", "tag", "spdx", f"{SPDX} cdla permissive [12] 0"),
    ("cdla-permissive-2", "name", "community data", f"community data {L} agreement permissive(?: {V}[12] 0)?"),
    ("cdla-sharing-1", "name", "community data", f"community data {L} agreement sharing(?: {V}1 0)?"),
    ("ogl-3", "tag", "spdx", f"{SPDX} ogl uk 3 0"),
    ("ogl-3", "name", "open government", f"open government {L} {V}3(?: 0)?"),
    ("ogl", "family", "open government", f"open government {L}"),
    ("openrail-m", "name", "rail", f"(?:creativeml |bigscience |bigcode )?(?:open )?rail m(?: {L})?"),
    ("openrail-m", "name", "openrail", f"(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: {L})?"),
    ("llama-community", "name", "llama", f"llama [234](?: [0-9])?(?: community)? {L}(?: agreement)?"),
    # no open license
    ("public-domain", "notice", "public domain", "(?:(?:is|are|been|was|were) )?(?:hereby )?(?:released|placed|dedicated|donated|put) (?:in ?to|in|to) the public domain"),
    ("public-domain", "hint", "public domain", "(?:is|are|in) (?:in )?the public domain"),
    ("proprietary", "notice", "confidential", "proprietary and confidential|confidential and proprietary"),
    ("proprietary", "notice", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) (?:of this (?:file|work|document|material) )?.{0,60}?is strictly prohibited"),
    ("proprietary", "name", "end user", f"end user {L} agreement"),
    ("proprietary", "name", "eula", "(?:the |this )?eula"),
    ("proprietary", "hint", "all rights reserved", "all rights reserved"),
    ("non-commercial", "notice", "non commercial", f"for (?:personal |research |academic )?(?:and )?non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "notice", "noncommercial", f"for (?:personal |research |academic )?(?:and )?noncommercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "name", "polyform", f"polyform noncommercial {L}(?: 1 0 0)?"),
    ("research-only", "notice", "research", "for (?:academic |scientific )?research (?:use|purposes) only"),
)
