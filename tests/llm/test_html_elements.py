"""Elements without an end tag, and those whose text belongs to the page."""

from tessera.llm import html_blocks


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


def test_elements_that_are_not_closed():
    assert texts("<datalist><option value=a><option value=b></datalist><p>kept</p>") == ["kept"]
    assert texts("<datalist id=d><option value=a>one<option value=b>two</datalist><p>kept</p><select><option>x</option></select>") == ["kept"]
    assert texts("<option>one<option>two<p>kept</p>") == ["kept"]
    for tag in ("object", "audio", "video", "canvas", "iframe", "select", "svg", "noscript", "template"):
        assert texts(f"<{tag}><p>kept</p>") == ["kept"]
        assert texts(f"<{tag} a=1><p>kept</p><{tag}>gone</{tag}><p>more</p>") == ["kept", "more"]
        assert texts(f"<p>a</p><{tag}>x<{tag}>y</{tag}>z</{tag}><p>b</p>") == ["a", "b"]
        assert texts(f"<{tag} title='a > b'>gone<!-- <{tag}> --><script>'<{tag}>'</script></{tag}><p>kept</p>") == ["kept"]
    assert texts("<p>a</p><script>only(") == ["a"]
    assert texts("<object>" * 20_000 + "<p>kept") == ["kept"]


def test_formulas_stay():
    page = "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='application/x-tex'>x = 1</annotation></math> holds</p>"
    assert texts(page) == ["so x=1 holds"]
