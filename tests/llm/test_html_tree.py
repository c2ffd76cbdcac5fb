"""The block classifier: what it learns from, and whole pages against texts known beforehand."""

import html
import random

import numpy as np

from tessera.llm import html_blocks, html_extraction, html_labels

WORDS = "Fluß río ça va silt the of delta & < >  x tide's \"quoted\" 3.5 €".split(" ")


def accuracy(spark, model, pages, names):
    rows = html_extraction.labelled(spark, pages, names).collect()
    got = html_extraction.Tree(model).is_main(np.array([r["features"].toArray() for r in rows]))
    return (got == np.array([r["label"] > 0.5 for r in rows])).mean()


def test_neighbours_decide(spark):
    assert len(html_labels.PAGES) > 60 and not set(html_labels.HELD_OUT) & set(html_labels.PAGES)
    for names, least in ((html_blocks.FEATURES, 0.99), (html_blocks.FLAT, 0.9)):
        model = html_extraction.train(spark, names=names)
        weight = dict(zip(html_blocks.FEATURES, model.featureImportances.toArray()))
        assert all(weight[n] > 0 for n in ("words", "links", "words_before", "links_before", "words_after", "links_after"))
        assert accuracy(spark, model, html_labels.HELD_OUT, names) >= least
    # without neighbours it does worse
    alone = ("words", "links", "heading", "item", "rights")
    assert accuracy(spark, html_extraction.train(spark, names=alone), html_labels.HELD_OUT, alone) < accuracy(spark, model, html_labels.HELD_OUT, html_blocks.FLAT)


def test_pages_with_known_texts(spark):
    rng = random.Random(11)

    def words(n):
        return [rng.choice(WORDS) for _ in range(n)]

    def marked(ws):
        """The words as markup: references, inline elements, comments and breaks that change no word."""
        out = []
        for w in ws:
            w = html.escape(w) if rng.random() < 0.7 or set(w) & set("<&") else w
            kind = rng.randrange(9)
            out.append(f"<b>{w}</b>" if kind == 0 else f'<a href="/x?a=1&amp;b">{w}</a>' if kind == 1 and rng.random() < 0.2 else f"{w}<!-- <p>no</p> -->" if kind == 2 else w)
        return rng.choice((" ", "\n\t", "&#32;", " <br> ")).join(out)

    rows, expected = [], {}
    for k in range(150):
        parts, blocks = [], []
        for _ in range(rng.randint(1, 9)):
            ws = words(rng.choice((1, 2, 5, 30, 80)))
            tag = rng.choice(("p", "p", "h2", "li", "blockquote", "td"))
            inner = marked(ws)
            parts.append({"li": f"<ul><li>{inner}</ul>", "td": f"<table><tr><td>{inner}</td></tr></table>"}.get(tag, f"<{tag}>{inner}</{tag}>"))
            text = " ".join(" ".join(ws).split())
            if text:
                blocks.append(text)
        noise = f"<nav><ul>{''.join(f'<li><a href=/{i}>{w}</a>' for i, w in enumerate(('Home', 'News', 'Über')))}</ul></nav>"
        after = rng.choice(("<aside><p>" + marked(words(40)) + "</p></aside>", "<section class='comments'><p>" + marked(words(60)) + "</p></section>", "<div class=cookie-notice>" + marked(words(25)) + "</div>", ""))
        page = f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body>{noise}<script>'</p>'</script><article>{''.join(parts)}</article>{after}<footer>&copy; 2020</footer></body></html>"
        rows.append((k, page))
        expected[k] = "\n\n".join(blocks)
    got = {r["page_id"]: r["main"]["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    wrong = [k for k in expected if got[k] != expected[k]]
    assert not wrong, (got[wrong[0]], expected[wrong[0]], rows[wrong[0]])
