from collections import Counter

import pytest

from loomline.llm import scans

CHUNKS = "chunk_index int, batch_num int, page_range string, source_file string, text string, words string, block long"
BODY = "the policyholder may surrender the contract after three years provided that premiums for that period were received"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, b, p, f, t, "w", 1) for i, (b, p, f, t) in enumerate(rows)], CHUNKS)


def sample():
    plain = [(1, "1-3", f"body-{i}.pdf", "\n".join([f"Under Clause {i}, {BODY}.", f"A half-yearly premium is paid when {BODY}."])) for i in range(30)]
    head = "Kestrel Mutual Life - Amber Steps"
    noisy = [
        (2, "4-6", "./Scan.pdf", f"{head}\nUnder Clause 1, the policy¬\nholder may surrender.\n- 5 -\nThe contract after three"),
        (2, "4-6", "scan.PDF ", f"The premiums were\n{head.upper()}  6\nreceived by the policyho|der."),
        (3, "9-7", "scan.pdf", "The period\nviii\nwas received. A half-\nyearly premium is paid.\n12.\n910\n300"),
        (2, None, "scan.pdf", "The contract\nP a g e  4\nwas received after clecision."),
        (2, "4-6", "scan.pdf", "Covered under Clause, Section and Form 3B -\nread with the contract."),
        (2, "4-6", "scan.pdf", "Covered under Clause, Section and Form 3B -\nread with the period."),
    ]
    decided = [(1, "1-3", f"d{i}.pdf", f"The decision of the policyholder number {i} was received.") for i in range(30)]
    return plain + noisy + decided + [(1, "1-3", None, None), (None, "", "", "")]


def test_kinds(spark):
    rows = sample()
    found = {}
    for r in scans.noise_kinds(rows_of(spark, rows)).collect():
        found.setdefault(r["chunk_index"], set()).add(r["kind"])
    assert found == {30: {"header", "hyphen", "page_no"}, 31: {"header", "misread"}, 32: {"page_no"}, 33: {"page_no", "misread"}}


def test_texts(spark):
    texts = {r["chunk_index"]: r["text"] for r in scans.clean_texts(rows_of(spark, sample())).collect()}
    assert texts[30] == "Under Clause 1, the policyholder may surrender. The contract after three"
    assert texts[31] == "The premiums were received by the policyholder."
    assert "half-yearly" in texts[32] and "viii" not in texts[32]
    assert texts[66] is None and texts[67] == ""
    assert len(texts) == len(sample())


def test_rows_ingested_twice_make_no_header(spark):
    row = (1, "1-3", "a.pdf", "Amber Steps :: Terms\nthe contract was received.")
    assert scans.noise_kinds(rows_of(spark, [row, row])).count() == 0
    other = (1, "1-3", "a.pdf", "AMBER  STEPS :: TERMS\nthe period was received.")
    assert scans.noise_kinds(rows_of(spark, [row, other])).count() == 2


@pytest.mark.parametrize(
    ("line", "answer"),
    [("- 5 -", True), ("[5]", True), ("Page 5 of 44", True), ("P a g e  5", True), ("Pg. 5/44", True), ("      5", True), ("v", True), ("V", True), ("५", True), ("— 5 —", True), ("12.", False), ("5.", False), ("9", False), ("Clause 5", False), ("5,000", False), ("", False), ("x" * 10_000, False)],
)
def test_page_numbers(line, answer):
    assert scans.is_page_number(line, scans.pages("6-4", 2)) is answer


def test_pages():
    assert list(scans.pages("p7–9", 1)) == [7, 8, 9] and list(scans.pages("", 2)) == [4, 5, 6] and list(scans.pages(None, None)) == []


def test_paragraphs():
    lines = ["The first sentence", "goes on here.", "", "The second one is of its own.", "", "and so it does not", "", "end before this."]
    assert scans.paragraphs(lines)[0] == "The first sentence goes on here."
    assert scans.paragraphs([]) == [] and scans.paragraphs([" "]) == []


def test_long_lines_end():
    counted = Counter()
    scans._listed("7" * 200_000 + "\n" + "word " * 20_000, range(1, 4), counted, set())
    assert counted["word"] == 20_000


def test_empty(spark):
    none = rows_of(spark, sample()).limit(0)
    assert scans.noise_kinds(none).count() == 0 and scans.clean_texts(none).count() == 0


def test_joint_decoding(spark):
    noisy = [
        (2, "4-6", "s.pdf", "The contract may be sur ren dered after three years."),  # parted twice
        (2, "4-6", "s.pdf", "The contr act was provided that premiums were received."),  # parted once
        (2, "4-6", "s.pdf", "The policyholdermaysurrender after three years."),  # three words run together
        (2, "4-6", "s.pdf", "The contractprovidecl that premiums were received."),  # misread and run together
        (2, "4-6", "s.pdf", "The pol icy¬\nholder may surrender."),  # a word that no word of the corpus explains stays
    ]
    plain = [(1, "1-3", f"b{i}.pdf", f"The policyholder may surrender the contract surrendered after three years number {i} provided that premiums were received.") for i in range(300)]
    rows = plain + noisy
    texts = {r["chunk_index"]: r["text"] for r in scans.clean_texts(rows_of(spark, rows)).collect()}
    assert texts[300] == "The contract may be surrendered after three years."
    assert texts[301] == "The contract was provided that premiums were received."
    assert texts[302] == "The policyholder may surrender after three years."
    assert texts[303] == "The contract provided that premiums were received."
    assert texts[5] == plain[5][3]
    found = {(r["chunk_index"], r["kind"]) for r in scans.noise_kinds(rows_of(spark, rows)).collect()}
    assert (303, "misread") in found and not {(i, k) for i, k in found if i in (300, 301, 302) or i < 300}


def test_beyond_former_bounds():
    # a continuation far below, over headers and page numbers; an unlimited number of lines in a paragraph; a long header
    lines = ["the sur-", "", "- 5 -", "Amber Steps Terms", "", "- 6 -", "Amber Steps Terms", "render is paid"]
    assert scans._joints(lines, range(4, 7))[0][0] == 7
    assert scans._joints(["the sur-", "A sentence of its own goes on here,", "render"], range(1))[0][0] == -1
    assert scans.paragraphs(["a line that goes on and on and does not end"] * 700) == [" ".join(["a line that goes on and on and does not end"] * 700)]
    assert scans.header_key("Amber Steps " * 40, range(1), "Amber Steps " * 40) is not None
    assert scans.is_page_number("Page" + " " * 90 + "5", range(4, 7))


def test_paragraphs_are_the_cheapest():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        lines = [rng.choice(["", "Short.", "a longer line that goes on", "A line that begins and ends a sentence here."]) for _ in range(rng.randint(1, 9))]
        kept, blanks, blank = [], [], False
        for line in lines:
            if line:
                kept.append(line)
                blanks.append(blank)
            blank = not line
        ends = [line[-1] == "." for line in kept]

        def cost(breaks):
            total, bounds = 0.0, [0, *breaks, len(kept)]
            for a, b in itertools.pairwise(bounds):
                total += 2.0 if sum(len(x) + 1 for x in kept[a:b]) < scans.SHORT_PARAGRAPH else 0.0
                total += ((0.0 if blanks[a] else 3.0) + (0.0 if ends[a - 1] else 2.5) + (1.5 if kept[a][0].islower() else 0.0)) if a else 0.0
                total += sum((2.5 if ends[k - 1] else -0.5) for k in range(a + 1, b) if blanks[k])
            return total

        if kept:
            least = min(cost(c) for n in range(len(kept)) for c in itertools.combinations(range(1, len(kept)), n))
            made = scans.paragraphs(lines)
            sizes = list(itertools.accumulate(len(p) + 1 for p in made))[:-1]
            starts = list(itertools.accumulate(len(x) + 1 for x in kept))
            assert abs(cost([starts.index(x) + 1 for x in sizes]) - least) < 1e-9
