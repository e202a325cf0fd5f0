"""Parser and chunker against a plain sequential model, on random inputs."""

import random

from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import chunking, parsing

BLANK = " \t\n\x0b\f\r\x00"


def model_sections(name, text):
    import re

    out, heading, lines, stack, path = [], name, [], {}, []

    def flush():
        body = "".join(lines).strip(BLANK)
        if body:
            out.append((heading, tuple(path), body))

    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        m = re.match(r"(#{1,6})[ \t\n\x0b\f\r]", line)
        if m:
            flush()
            title = re.sub(r"(\r\n|\n|\r)\Z", "", re.sub(r"^#+[ \t\n\x0b\f\r]*", "", line))
            stack = {d: t for d, t in stack.items() if d < len(m[1])} | {len(m[1]): title}
            heading, lines, path = title, [], [t for _, t in sorted(stack.items())]
        else:
            lines.append(line)
    flush()
    return out or [(name, (), text.strip(BLANK))]


def model_chunks(content, most):
    import re

    out, buffer = [], ""
    for p in (x for x in re.split(r"\n\n+", content) if x):
        joined = p if not buffer else buffer + "\n\n" + p
        if len(joined) <= most:
            buffer = joined
            continue
        if buffer:
            out.append(buffer)
        if len(p) > most:
            out += [p[i : i + most] for i in range(0, len(p), most)]
            buffer = ""
        else:
            buffer = p
    return out + ([buffer] if buffer else [])


def test_sections_match_the_model(spark):
    draw = random.Random(1)
    bits = ["# ", "## ", "### ", "####### ", "#", "a", "é👍", "\n", "\n", "\n\n", " ", "```", "\r\n", "x y", "#\n", "\t"]
    files = [(f"/d/f{i}.md", "".join(draw.choice(bits) for _ in range(draw.randint(0, 25)))) for i in range(400)]
    df = spark.createDataFrame(files, "path string, content string")
    got = {}
    for r in parsing.parse_markdown(df).orderBy("section_ord").collect():
        got.setdefault(r.source_file, []).append((r.heading, tuple(r.section_path), r.content))
    for path, text in files:
        assert got[path] == model_sections(path.split("/")[-1][:-3], text), text


def test_chunks_match_the_model(spark):
    draw = random.Random(2)
    texts = ["\n\n".join("é" * draw.choice([0, 1, 30, 78, 79, 80, 81, 200]) for _ in range(draw.randint(0, 9))) + draw.choice(["", "\n", "\n\n\n"]) for _ in range(400)]
    df = spark.createDataFrame([(str(i), 0, "h", ["p"], t) for i, t in enumerate(texts)], "source_file string, section_ord int, heading string, section_path array<string>, content string")
    got = {}
    for r in chunking.chunk(df, 20, overlap_tokens=128).orderBy("chunk_index").collect():
        got.setdefault(int(r.source_file), []).append((r.chunk_index, r.content, r.token_count))
    for i, t in enumerate(texts):
        want = model_chunks(t, 80)
        assert got.get(i, []) == [(k, c, -(-len(c) // 4)) for k, c in enumerate(want)]


def test_scalar_rules(spark):
    row = spark.range(1).select(
        T.content_hash(F.lit("  A  b\n\tC ")).alias("a"), T.content_hash(F.lit("a b c")).alias("b"), T.question_hash(F.lit("same")).alias("q"),
        T.extension(F.lit("/x/.hidden")).alias("e0"), T.extension(F.lit("/x.d/N.MD")).alias("e1"), T.stem(F.lit("/a/b.c.txt")).alias("s"),
        T.zero_embedding(F.lit(None).cast("array<float>")).alias("z0"), T.zero_embedding(F.array(F.lit(0.0))).alias("z1"), T.zero_embedding(F.array(F.lit(0.1))).alias("z2"),
    ).first()
    assert row.a == row.b and row.q == "0967115f2813a354"
    assert (row.e0, row.e1, row.s) == ("", ".md", "b.c")
    assert (row.z0, row.z1, row.z2) == (True, True, False)
