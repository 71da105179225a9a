"""Seeded inputs in the native formats."""

import hashlib
import random

import pandas as pd


def six_fields(seed=1, rows=600):
    """Unbalanced groups, nulls, a group without negatives, one of one row, one of nulls, a maximum of 0."""
    r = random.Random(seed)
    out = []
    for i in range(rows):
        grp, sub = min(2, int(r.expovariate(1))), min(3, int(r.expovariate(0.7)))
        out.append([i, grp, sub, r.randint(1, 9), r.randint(1, 9), r.uniform(1, 10), r.uniform(1, 10), r.gauss(0, 10), r.gauss(1, 10)])
        if r.random() < 0.1:
            out[-1][5 + r.randrange(3)] = None
    n = rows
    out += [[n + k, 7, 0, 1, 1, 2.0, -float(k), 1.0 + k, 0.0] for k in range(5)]
    out += [[n + 5, 8, 0, 1, 1, 2.0, 3.0, -4.0, 0.0], [n + 6, 9, 0, 1, 1, None, None, None, 0.0]]
    return out


def section_text(students=12, seed=2, uneven=True):
    r = random.Random(seed)
    lines = []
    for s in range(1, students + 1):
        lines.append(f"S,{s},John{s}")
        for t in range(r.randint(1, 8) if uneven else 8):
            lines.append(f"TH,{2010 + t}-0{r.randint(1, 9)}-01,{r.random() < 0.1}")
            for _ in range(r.randint(0, 4) if uneven else 4):
                lines.append(f"C,{r.randrange(4)},{r.randint(1, 5)},{r.randrange(5)}")
            lines.append(f"TF,{r.randrange(4)},{r.uniform(1, 4):.3f},{r.randint(5, 15)}")
    return lines


def section_oracle(lines):
    """One pass in plain Python: {student: (name, lines, gpa, major, major gpa)}."""
    out, now, term = {}, None, None
    for line in lines:
        f = line.split(",")
        if f[0] == "S":
            now, term = {"n": 1, "c": [0] * 4, "p": [0] * 4, "m": None, "name": f[2]}, None
            out[int(f[1])] = now
        elif f[0] == "TH":
            term = []
        elif f[0] == "C" and term is not None:
            term.append(tuple(map(int, f[1:])))
        elif f[0] == "TF" and term is not None and now is not None:
            now["n"] += len(term) + 2
            now["m"] = int(f[1])
            for d, c, g in term:
                now["c"][d] += c
                now["p"][d] += c * g
            term = None
    mean = lambda p, c: p / max(1, c)
    return {s: (x["name"], x["n"], mean(sum(x["p"]), sum(x["c"])), x["m"], None if x["m"] is None else mean(x["p"][x["m"]], x["c"][x["m"]])) for s, x in out.items()}


def people(count=20, sources="ABC"):
    """One row per person and source; source B has few people."""
    rows, n = [], 0
    for s, letter in enumerate(sources):
        for i in range(1, (max(1, count // 50) if letter == "B" else count) + 1):
            digest = hashlib.sha512(str(i).encode()).hexdigest()
            factor = {"A": 2, "B": 3, "C": 5, "D": 7, "E": 11, "F": 13}[letter]
            fields = {f"Field{x}": str(i * factor) if x == letter else None for x in "ABCDEF"}
            rows.append({"FirstName": f"FFFFFF{letter}{i}_{digest}", "LastName": f"LLLLLL{letter}{i}_{digest}", "StreetAddress": f"{i} Main St", "City": "Plaineville ME", "ZipCode": f"{(i - 1) % 100:05d}", "SecretKey": i, **fields, "SourceId": s, "id": n})
            n += 1
    return pd.DataFrame(rows)
