import textwrap

from trialstats.llm import licenses as L

SCANNER = L.Scanner()


def names(text):
    found = SCANNER.scan(text)[1]
    assert all(text[n["start"] : n["end"]].strip() == text[n["start"] : n["end"]] for n in found)
    return [n["license"] for n in found]


def test_every_template_finds_itself():
    for name, wording in L.TEMPLATES:
        assert names(f"some text\n{wording}.\nmore") == [name], wording


def test_wording_differences_decide():
    assert names("Licensed under the Apache License, Version 1.1") == []
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert names("RELEASED  under the mit license") == ["MIT"]
    assert names("the driver has a license and a permission slip") == []
    assert names("Released under the MIT License. Licensed under CC BY-NC 4.0. All rights reserved.") == [
        "MIT", "CC-BY-NC-4.0", "all-rights-reserved"]


def test_long_line_and_modified_grant():
    grant = dict((w, n) for n, w in L.TEMPLATES if n == "BSD-3-Clause")
    text = "x " * 5000 + next(iter(grant)).replace("source and binary", "source or binary") + " y" * 5000
    candidates, found = SCANNER.scan(text)
    assert [(n["license"], n["missing"], n["added"]) for n in found] == [("BSD-3-Clause", 1, 1)]


def test_tables(spark, documents, odd_documents, no_documents):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "all-rights-reserved",
    }
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in L.scan(documents).collect():
        want = [name for line in texts[r.doc_id].split("\n") for s, name in lines.items() if s in line]
        assert [n.license for n in r.notices] == want
    assert {r.candidates for r in L.scan(odd_documents).collect()} == {0}
    assert L.scan(no_documents).count() == 0


PROSE = ("in the early days of the village the river ran past the mill and nobody kept a record of it so what we know "
         "comes from letters that were found under the floor of the old school when it was sold ").split()


def test_notices_inside_running_prose():
    for around in (3, 8, 30, 200):
        for name, wording in L.TEMPLATES:
            words = (PROSE * 7)[:around]
            assert names(f"{' '.join(words)} {wording} {' '.join(reversed(words))}") == [name], (around, wording)


def test_one_word_added_inside_prose():
    for name, wording in L.TEMPLATES:
        words = wording.split()
        if len(words) >= 10:
            changed = " ".join([*words[: len(words) // 2], "indeed", *words[len(words) // 2 :]])
            assert names(f"{' '.join(PROSE)} {changed} {' '.join(PROSE)}") == [name], changed


def test_wrapped_notices_with_comment_signs():
    for name, wording in L.TEMPLATES:
        for width in (30, 72):
            for sign in ("", " * ", "# ", "// ", "dnl "):
                text = "\n".join(sign + line for line in textwrap.wrap(wording, width))
                assert names(f"first line\n{text}\n\nint main") == [name], text


def test_naming_words_decide():
    for word in ("Affero", "Lesser"):
        assert names(f"This work is licensed under the GNU {word} General Public License, version 3.") == []
    assert names("Licensed under the License") == []
    assert names("Licensed under CC BY-ND 4.0.") == []
