import random
import re

from tidewake.llm import licences as lic

MIT = """The MIT License (MIT)

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_every_known_sentence_is_found():
    s = lic.Scanner()
    for name, text in lic.SENTENCES:
        assert s.identifiers(f"Some words.\n{text}\nOther words here.") == [name], text


def test_rules_are_ordered():
    s = lic.Scanner()
    ids = s.identifiers(MIT)
    assert ids == ["mit-title", "mit-grant", "mit-notice", "as-is"] and s.licences(ids) == ["MIT"]
    assert s.licences(["mit-grant"]) == [] and s.licences(["GPL-3-redistribute", "gpl-hope", "cc-by-note"]) == ["GPL-3.0-or-later", "CC-BY-4.0"]


def brute(text):
    """Every known sentence tried as text at every place, and every rule at every identifier; nothing is taken from the scanner."""
    low = re.sub(r"[^\W_]+", lambda m: m[0] + "\0", text.lower())  # \0 ends a word
    plain, cuts = "", {0}
    for piece in re.split(r"(\0)", low):
        if piece == "\0":
            continue
        letters = re.sub(r"[\W_]", "", piece)
        gap = piece[: len(piece) - len(letters)] if letters else piece
        if "\n" in gap or re.search(r"[.!?;:]\s", gap):
            cuts.add(len(plain))
        if letters:
            plain += letters + " "
    cuts.add(len(plain))
    ids, at = [], 0
    while at < len(plain):
        hits = []
        for name, s in lic.SENTENCES:
            key = " ".join(re.findall(r"[^\W_]+", s.lower())) + " "
            if plain.startswith(key, at) and at in cuts and at + len(key) in cuts:
                hits.append((len(key), name))
        if hits:
            n, name = max(hits)
            ids.append(name)
            at += n
        else:
            at = plain.index(" ", at) + 1
    out, rest = [], ids
    while rest:
        hit = next(((k, w) for k, w in lic.RULES if tuple(rest[: len(w)]) == w), None)
        out += [hit[0]] if hit else []
        rest = rest[len(hit[1]) if hit else 1 :]
    return ids, out


def test_matches_brute_force():
    s = lic.Scanner()
    rnd = random.Random(8)
    known = [t for _, t in lic.SENTENCES]
    texts = [MIT, MIT.upper().replace("\n", "\r\n"), "x\n".join(known), "\n".join(known), "no licence here", "a licence_note x: MIT License; b"]
    for _ in range(150):
        parts = [rnd.choice(known) if rnd.random() < 0.7 else rnd.choice(["some words", "more of it.", "License", "the program:"]) for _ in range(rnd.randint(1, 8))]
        t = rnd.choice(["\n", " ", "\n\n", " x "]).join(parts)
        if rnd.random() < 0.5:  # wrapped lines, and a changed word
            w = t.split(" ")
            w[rnd.randrange(len(w))] += rnd.choice(["", "", "x"])
            t = "".join(x + rnd.choice([" ", " ", " ", "\n"]) for x in w)
        texts.append(t)
    for t in texts:
        ids = s.identifiers(t)
        assert (ids, s.licences(ids)) == brute(t), t


def notice(name, version, what="program"):
    return (f"This {what} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {name} Public\nLicense as published by the Free "
            f"Software Foundation; either\nversion {version} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that "
            f"it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\n"
            f"{name} Public License for more details.\n")


def test_notices_of_one_family_are_told_apart():
    s = lic.Scanner()
    scan = lambda t: s.licences(s.identifiers(t))
    assert scan(notice("General", "2")) == ["GPL-2.0-or-later"] and scan(notice("General", "3")) == ["GPL-3.0-or-later"]
    assert scan(notice("Library General", "2", "library")) == ["LGPL-2.0-or-later"] and scan(notice("Lesser General", "2.1", "library")) == ["LGPL-2.1-or-later"]
    assert scan(notice("Affero General", "3")) == ["AGPL-3.0-or-later"]
    assert scan("either version 2 of the License, or (at your option) any later version.") == []
    assert scan("                                 Apache License\n                           Version 2.0, January 2004\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n") == ["Apache-2.0"]
    assert scan(MIT + "\n\n" + MIT) == ["MIT", "MIT"]


def test_edges(documents):
    filler = "word " * 100_000
    rows = [(1, None), (2, ""), (3, filler + "\nReleased under the MIT License."), (4, "Released under the MIT License"), (4, "Released under the MIT License"),
            (5, "He said the MIT License. was released"), (None, "licensed under cc by 4.0")]
    got = [(r["doc_id"], r["licences"]) for r in lic.scan_licences(documents(rows, extra=True)).collect()]
    assert got[2][1] == ["MIT"] and got.count((4, ["MIT"])) == 2 and (None, ["CC-BY-4.0"]) in got
    assert all(x == [] for d, x in got if d in (1, 2, 5))
    assert lic.scan_licences(documents([])).count() == 0
