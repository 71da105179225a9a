"""Small seeded corpora with everything that may go wrong in them."""

import random

ODD = [
    None, "", " ", "\n\n \t", "one", "two words", "a b c d", "a b c d e", "A B C D E", "ſtraße ÇA été  naïve", "x y z", "\x00 zero", "<|endoftext|> in <|startoftext|>text<|endoftext|><|endoftext|>",
    "it's they'LL 12,345.67 #*$%&|<>", "😀 👩‍👩‍👧 é ẛ̣", "same same same same same same same same same same same same same same same same same same same same same same same",
]


def texts(n=60, seed=1, words=120):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)] + ["Die", "Straße", "été", "the", "of"]
    out = []
    for _ in range(n):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 25))).capitalize() + "." for _ in range(r.randint(1, words // 12))]
        out.append("\n".join(lines))
    return out, vocabulary


def corpus(n=60, seed=1):
    """(id, text) with odd texts, copies, near copies, shared passages, a very long text, a null id and repeated rows."""
    r = random.Random(seed)
    base, vocabulary = texts(n, seed)
    rows = [*ODD, *base]
    rows += [base[0], base[0], base[1]]
    for i in range(12):
        w = base[2 + i % 3].split(" ")
        for _ in range(1 + i % 4):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append(" ".join(w))
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    for i in range(4):
        rows.append(f"{base[10 + i]} {passage} {base[20 + i]}")
    rows.append(" ".join(passage.split(" ")[10:62]))
    rows.append(f"{passage}\n{passage}")
    rows.append(" ".join(r.choice(vocabulary) for _ in range(30_000)))
    out = list(enumerate(rows))
    out += [(None, base[5]), (None, None), out[20], out[20]]
    r.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, source string, n_words string, digest int, word string"


def documents(spark, rows, parts=3):
    """Rows as a table with extra columns whose names an operator might use itself."""
    sources = ["a", "b", "b", "b", None]
    full = [(i, t, sources[n % 5], "clash", n, "w") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


def saved(spark, path, rows, **columns):
    """The same written to files, in which order is fixed."""
    documents(spark, rows).write.parquet(str(path))
    return spark.read.parquet(str(path))
