import collections
import random
import re
import threading

from pyspark.sql import functions as F

from skylattice.llm import lines


def repeated(words):
    """Words in three-word windows found twice or more."""
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    found = collections.Counter(windows)
    return len({i + k for i, x in enumerate(windows) if found[x] > 1 for k in range(3)})


def texts():
    rng = random.Random(5)
    few = [" ".join(rng.choice("ab") for _ in range(n)) for n in (2, 3, 4, 9, 60)]
    return [*few, *(" ".join(f"w{rng.randrange(40)}" for _ in range(900)) for _ in range(5)), " ".join(f"w{i}" for i in range(900)), "x y z " * 300, "", "a\x00b c", " \n"]


def test_a_filter_on_the_result_makes_nothing_again_for_each_window(spark, docs_of):
    """The planner moves the filter to the rows; windows were then sorted anew for each window, which didn't end for a text of 900 words."""
    want = {i: repeated(t.split()) for i, t in enumerate(texts())}
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = lines.clean_lines(docs_of(texts())).where("n_repeat_words > 0 and clean_words >= 0").select("doc_id", "n_repeat_words").collect()
    finally:
        stop.cancel()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: n for i, n in want.items() if n}


def test_windows_whose_hashes_meet_are_compared_as_words(spark):
    """All windows as if they had one hash: only equal ones count."""
    held = [t.split() for t in texts()]
    rows = spark.createDataFrame([(i, w, list(range(len(w) - 2))) for i, w in enumerate(held) if len(w) > 2], "i long, words array<string>, placed array<long>")
    got = rows.select("i", lines.repeated_words(F.col("placed"), F.col("words")).alias("n")).collect()
    assert len(got) > 9 and all(r.n == repeated(held[r.i]) for r in got)


def test_each_phrase_of_a_line_is_looked_for_in_the_text():
    found = [x.replace("terms of (use|service)", "terms of use") for x in re.split(r"\|(?![^(]*\))", lines.BOILERPLATE[1:-1])]
    assert len(found) == 12 and all(re.search(lines.BOILERPLATE, x) and any(p in x for p in lines.PHRASES) for x in found)


def test_rules_are_tried_where_the_text_holds_what_they_look_for(spark, docs_of):
    """The flags of the whole text change no verdict on any of its lines."""
    rng = random.Random(9)
    parts = ["plain words without an end here now", "It ends.", "a | b | c | d", "## $$ ##", "no!! no!! no!!", "CLICK HERE", "Terms of Service apply to all of it", "terms of sale apply.", "bac\u212a to top", "x", "", "İ read more", "Log in!!"]
    docs = docs_of(["\n".join(rng.choice(parts) for _ in range(n)) for n in (1, 1, 1, 2, 2, 3, 4, 8) for _ in range(40)] + parts)
    plain = docs.withColumn("line", F.explode(F.split("text", "\n"))).where(F.regexp_like("line", F.lit(r"[^\x20\x09-\x0D]"))).where(~lines.line_failed(F.col("line")))
    want = collections.defaultdict(list)
    for r in plain.select("doc_id", "line").collect():
        want[r.doc_id].append(r.line)
    for r in lines.clean_lines(docs).collect():
        assert sorted(r.clean_text.split("\n") if r.clean_text else []) == sorted(want[r.doc_id]) and r.clean_words == sum(len(x.split()) for x in want[r.doc_id])
