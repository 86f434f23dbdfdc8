"""

``python tests/pandas_timing.py [sf_dir]`` prints one JSON line.  Rows are
treated one at a time with plain Python functions, as pandas preparation
scripts do; each figure includes reading the table.
"""

import collections
import hashlib
import json
import math
import re
import sys
import time

import pandas as pd


def clean(line):
    for mark in ("“", "”", "//", "«", "»", ",", ";", "."):
        line = line.replace(mark, "")
    return re.sub(r"\s+", " ", line).strip()


def pattern(text, least):
    return "".join("+" if len(w) >= least else "-" for w in text.split(" "))


def model(text):
    return "".join("+" if len(w) >= 5 and not (len(w) == 5 and w[-1] == "e") else "-" for w in text.split(" "))


def verses(folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "lang", "text"])
    docs = docs.sort_values("doc_id")
    docs["raw"] = docs.pop("text").apply(lambda t: t.replace(". ", ".\n").split("\n"))
    lines = docs.explode("raw", ignore_index=True)
    lines["text"] = lines.raw.apply(clean)
    return lines[lines.text != ""]


def encode(meter, pad=12):
    return ([1 if s == "+" else 0 for s in meter] + [0] * pad)[:pad]


def kept(folder):
    rows = verses(folder)
    rows = rows.assign(meter=rows.text.apply(pattern, least=5), pred=rows.text.apply(model))
    rows = rows.assign(length=rows.meter.str.len()).drop_duplicates(["lang", "text"])
    return rows[rows.length.between(4, 12)]


def clean_text(folder):
    return verses(folder)


def encode_meter(folder):
    rows = verses(folder)
    return rows.text.apply(pattern, least=5).apply(encode)


def dedup_first(folder):
    return verses(folder).drop_duplicates(["lang", "text"])


def exact_match(folder):
    rows = kept(folder)
    decoded = rows.pred.apply(encode).apply(lambda v: "".join("+" if x else "-" for x in v))
    fitted = [p[:n] for p, n in zip(decoded, rows.length)]
    return (rows.meter == fitted).groupby(rows.lang).mean()


def split_three_way(folder):
    rows = kept(folder)
    rows = rows.assign(h=[hashlib.md5(f"42|{a}|{b}".encode()).hexdigest() for a, b in zip(rows.lang, rows.text)])
    out = []
    for _, group in rows.sort_values("h").groupby("lang"):
        test = math.ceil(len(group) * 0.15)
        dev = math.ceil((len(group) - test) * 0.176)
        out.append(group.assign(split=["test"] * test + ["dev"] * dev + ["train"] * (len(group) - test - dev)))
    return pd.concat(out)


def vocab_rank(folder):
    table = str.maketrans({c: " " for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'})
    counts = collections.Counter()
    for text in kept(folder).text:
        counts.update(text.lower().translate(table).split())
    return counts.most_common(9999)


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    seconds = {}
    for work in (clean_text, encode_meter, dedup_first, exact_match, split_three_way, vocab_rank):
        start = time.time()
        work(folder)
        seconds[work.__name__] = round(time.time() - start, 3)
    print(json.dumps(seconds))


if __name__ == "__main__":
    main()
