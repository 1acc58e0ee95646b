"""The licence scan against a plain reader of words, which shares the tables with it but no pattern."""

import random

from passwatch.llm import licenses
from tests.oracle import SF, connect

MARKS = "/*#;%!>-"
DROPPED = " \t\r,\"'`()"
ENDS = ".;:!?"


def sentences_of(text):
    """Lists of words: lines and sentences, without comment marks and list marks."""
    low = (text or "").lower()
    out, at = [], 0
    while (cue := low.find("spdx-license-identifier", at)) >= 0:
        rest = low[cue + 23 :]
        name = rest.lstrip(" \t")
        if name.startswith(":"):
            low = low[:cue] + "\nspdx=" + name[1:].lstrip(" \t")
        at = cue + 1
    for line in low.split("\n"):
        line = line.lstrip(" \t")
        line = line.lstrip(MARKS).lstrip(" \t") if line[:1] and line[0] in MARKS else line
        bare = line.lstrip(" \t")
        mark = bare[1:] if bare.startswith("(") else bare
        for n in (2, 1):
            body = mark[:n]
            if mark[n : n + 1] == ")" and len(body) == n and (body[0].isascii() and body[0].isalnum()) and (n == 1 or body[1] in "0123456789"):
                line = mark[n + 1 :]
                break
        now, words = "", []

        def close():
            nonlocal now, words
            if now:
                words.append(now)
            now = ""
            if words:
                out.append(words)
            words = []

        flat = "".join(" " if c in DROPPED else c for c in line).strip(" ")
        i = 0
        while i < len(flat):
            if flat[i] in ENDS:
                j = i
                while j < len(flat) and flat[j] in ENDS:
                    j += 1
                if j == len(flat) or flat[j] == " ":
                    close()
                else:
                    now += flat[i:j]
                i = j
            elif flat[i] == " ":
                if now:
                    words.append(now)
                now, i = "", i + 1
            else:
                now, i = now + flat[i], i + 1
        close()
    marker = lambda w: len(w) == 1 and len(w[0]) <= 2 and w[0][0].isascii() and w[0][0].isalnum() and w[0][1:] in ("", *"0123456789")
    return [w for w in out if not marker(w)]


def plain(text):
    known = {tuple(k.split(" ")): v for k, v in licenses.known().items()}
    longest = sorted(known, key=lambda k: (-len(" ".join(k)), " ".join(k)))
    lines, ids, i = sentences_of(text), [], 0
    while i < len(lines):
        if lines[i][0].startswith("spdx="):
            joined = " ".join(lines[i])[5:]
            words = "".join(c if c.isascii() and (c.isalnum() or c in ".+-") else " " for c in joined).split()
            for w in (w.lstrip(".+-").rstrip(".") for w in words):
                if w and w not in ("or", "and", "with"):
                    name = next((n for n in [*licenses.NAMES, *licenses.SPDX] if n.lower() == w), None)
                    ids.append(f"spdx:{name or w}")
            i += 1
            continue
        for sentence in longest:
            j, left = i, list(sentence)
            while left and j < len(lines) and left[: len(lines[j])] == lines[j]:
                left, j = left[len(lines[j]) :], j + 1
            if not left:
                ids.append(known[sentence])
                i = j
                break
        else:
            ids.append("?")
            i += 1
    n = sum(x != "?" for x in ids)
    for name, gap, parts in licenses.RULES:
        i = 0
        while i < len(ids):
            end = i + 1 if ids[i] == parts[0] else None
            for part in parts[1:]:
                if end is None:
                    break
                j = end
                while j < len(ids) and j - end < gap and ids[j] == "?":
                    j += 1
                if j < len(ids) and ids[j] == part.rstrip("?"):
                    end = j + 1
                elif not part.endswith("?"):
                    end = None
            if end is not None:
                ids[i:end] = ["=" + name]
            i += 1
    names = {*licenses.NAMES, *licenses.SPDX}
    of = lambda x: x[1:] if x[0] == "=" else x.split(":", 1)[1] if x.startswith("ref:") or (x.startswith("spdx:") and x[5:] in names) else None
    return n, ",".join(sorted({of(x) for x in ids if of(x)})), ",".join(sorted({x for x in ids if not of(x) and x != "?"}))


def scanned(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    got = {r.doc_id: (r.n_sentences, r.licenses, r.unmatched) for r in rows}
    return [got[i] for i in range(len(texts))]


def whole(*parts):
    return "\n".join(licenses.SENTENCES[p] for p in parts)


def test_stated_cases(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\n" + whole("apache-comply", "apache-copy") + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + whole("apache-asis", "apache-see")
    texts = {
        "// SPDX-License-Identifier: MIT": (1, "MIT", ""),
        "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-2-Clause */": (3, "BSD-2-Clause,GPL-2.0-only", "spdx:linux-syscall-note"),
        "It is free. licensed under the terms of the MIT license": (1, "MIT", ""),
        whole("mit-grant") + "\n" + "words of no licence. " * 5000 + "\n" + whole("mit-notice"): (2, "", "mit-grant,mit-notice"),
        "MIT License\n\nCopyright (c) 2020 X\n\n" + whole("mit-grant", "mit-notice", "mit-warranty", "mit-liability"): (4, "MIT", ""),
        apache: (6, "Apache-2.0", ""),
        "mit": (0, "", ""),
        "1. " + whole("bsd-source"): (1, "", "bsd-source"),
        whole("bsd-grant") + "\n\n  1. " + whole("bsd-source") + "\n  2) " + whole("bsd-binary") + "\n" + whole("bsd-warranty", "bsd-liability"): (5, "BSD-2-Clause", ""),
        whole("lgpl-free", "lgpl-warranty", "lgpl-more"): (3, "LGPL-2.1-or-later", ""),
        whole("agpl-free", "gpl-warranty", "agpl-more", "agpl-copy", "gpl-see"): (5, "AGPL-3.0-or-later", ""),
        whole("zlib-warranty", "zlib-liability", "zlib-grant"): (3, "Zlib", ""),
    }
    assert scanned(spark, list(texts)) == list(texts.values())
    assert [plain(t) for t in texts] == list(texts.values())


def test_equals_plain_reader(spark):
    r = random.Random(3)
    pieces = list(licenses.SENTENCES.values()) + [p.format(f) for p in licenses.PHRASES for f in ("MIT License", "CC BY 4.0", "GPLv3")]
    pieces += ["SPDX-License-Identifier: Apache-2.0 OR MIT", "spdx-license-identifier : foo-1.0", "Some words, unknown", "Copyright (c) 2021 A. Nobody", "1.", "b)", "(2) licence", "", "See http://a.b/c; mit"]
    texts = [None, "", " \n\t", "permission"]
    for _ in range(150):
        text = ""
        for piece in r.sample(pieces, r.randrange(1, 7)) if r.random() < 0.5 else [licenses.SENTENCES[p.rstrip("?")] if p.rstrip("?") in licenses.SENTENCES else "Licensed under Apache License 2.0" for p in r.choice(licenses.RULES)[2]]:
            if r.random() < 0.1:
                text += r.choice(["An unknown one. ", "Two. Unknown ones.\n"])
            if r.random() < 0.4:
                piece = "".join("\n" + r.choice(["", "# ", " * ", "// "]) if c == " " and r.random() < 0.1 else c for c in piece)
            text += r.choice(["", "", "# ", " * ", "1. ", "- "]) + piece + r.choice(["\n", "\n\n", ". ", "; ", " "])
        texts.append(text)
    texts += [t for (t,) in connect(SF).execute("SELECT text FROM documents").fetchall()]
    assert scanned(spark, texts) == [plain(t) for t in texts]
