"""Text inside math, svg, object and noscript is the page's text like any other."""

from corpuslake.llm.html_blocks import leaf_blocks
from corpuslake.llm.html_crf import default_field


def texts(html):
    return [b.text for b in leaf_blocks(html)]


def test_embedded_text_is_kept():
    formula = "<math><semantics><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow><annotation>x{+}1</annotation></semantics></math>"
    assert texts(f"<p>Let {formula} be even.</p>") == ["Let x+1 be even."]
    assert texts("<p>See <svg><title>t</title><style>a{}</style><path d=x /><text>the chart</text></svg> here.</p>") == ["See the chart here."]
    assert texts("<p>A <object data=f><param name=a>plain copy</object> follows.</p>") == ["A plain copy follows."]
    assert texts("<p>One</p><noscript><p>Two <b>b</b></p></noscript><p>Three</p>") == ["One", "Two b", "Three"]
    assert texts("<p>One <svg><p>Two") == ["One", "Two"]


def test_what_is_never_shown_stays_hidden():
    head = "<head><title>t</title><noscript><style>p{}</style><link href=x></noscript><script>1</script></head>"
    assert texts(head + "<body><template>no</template><textarea>no</textarea><select><option>no</select><p>Yes</p>") == ["Yes"]


def test_articles_keep_it():
    prose = "The river runs past the old mill and turns to the north, where the stones are green. " * 3
    page = f"<html><body><article><h1>On rivers and mills</h1><p>{prose}</p><p>{prose}If <math><mi>y</mi><mo>=</mo><mn>7</mn></math> holds, it floods. {prose}</p><noscript><p>{prose}Fallback.</p></noscript></article></body></html>"
    found = default_field().extract(page)
    assert "If y=7 holds, it floods." in found and "Fallback." in found
