"""Small documents with every awkward case: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("fp", T.IntegerType()),
    T.StructField("chunk", T.StringType()),
])


def texts():
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["É", "naïve", "don't", "x's", "it's"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(45)
    base = prose(120)
    out = [None, "", " ", "\n\t ", "one", "One two", "a b c", prose(19), prose(20), prose(21)]
    out += [base] * 4 + [base.replace("w1 ", "zz ", 1), base + " tail", "head " + base]
    out += [prose(30) + " " + passage + " " + prose(25) for _ in range(4)]
    out += [passage, passage + "\n" + passage, "a a " * 40, "x " * 25 + "y", "spam " * 3000]
    out += ["  two  spaces ", "tab\tand\nline\r\nend ", "end space ", " nbsp  em", "CC BY-NC 4.0", "日本語 テキスト 👍🏽 mixed"]
    out += ["Licensed under CC BY-NC 4.0. All rights reserved.", "This work is licensed under the GNU General Public License, version 3. all\nrights  reserved"]
    out += [prose(4000), prose(60) + "\x00\x01\x1c\x1d\x85 " + prose(3), "<|endoftext|> plain", "it's 12 34's"]
    out += [prose(r.randint(1, 60)) for _ in range(20)]
    return out


def rows():
    out = [(i * 3 % 101 if t is not None else i, t, "en", f"src{i % 3}", "k", i, None) for i, t in enumerate(texts())]
    out.append(out[12])  # a repeated row
    out.append((None, out[12][1], None, None, None, None, None))  # no id
    out.append((out[20][0], "w1 w2 other", "en", "src0", "k", 1, "c"))  # one id, another text
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
