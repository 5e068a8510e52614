"""Labelled pages that the block model is trained on.

Elements with ``data-label="main"`` hold main text; all else on a page is not.
The layouts differ in tags, names and order, so that no single cue decides.
"""

_P = (
    "The council met on Tuesday and agreed, after a long debate, to mend the old bridge before winter comes.",
    "Nobody had expected the vote to be close, but in the end three members changed their minds.",
    "Der Rat hat am Dienstag nach langer Debatte beschlossen, die alte Brücke noch vor dem Winter zu erneuern.",
    "Le conseil a décidé mardi, après un long débat, de réparer le vieux pont avant l'hiver.",
    "El consejo decidió el martes, tras un largo debate, arreglar el viejo puente antes del invierno.",
    "Costs are put at four million; the work is to begin in spring and last for two years.",
    "“It is high time,” said the mayor, who had spoken for the plan from the first day.",
    "Short note.",
    "Old bridge figures tables and names of the year without any mark at the end",
    "bridge " * 40,
    "the | old | bridge | of | the | year",
)
_MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "the", "about us", "contact", "and"))
_FOOT = "&copy; 2024 example.com &middot; All of the old bridge and more. Imprint."
_AD = "Buy now and save more than half of the price on all shoes. Offer ends today."

LAYOUTS = (
    '<html lang="en"><head><title>{p0}</title></head><body><nav><ul>{menu}</ul></nav><div class="ad">{ad}</div><article data-label="main"><h1>{p7}</h1><p>{p0}</p><p>{p1}<br>{p5}</p><p><b>{p6}<br><p>{p2}</p></article><footer>{foot}</footer></body></html>',
    '<html><head><title>{p7}</title></head><body><nav><ul>{menu}</ul></nav><div class="ad">{p3}</div><article data-label="main"><h1>{p2}</h1><p>{p7}</p><p>{p3}</p></article><footer>{p1}</footer></body></html>',
    '<body><header><h1>Example daily</h1><p>{p1}</p></header><nav>{menu}</nav><main><article data-label="main"><h1>{p4}</h1><p>{p4}</p><ul><li>{p7}</li><li>{p5}</li></ul></article><aside><h2>Related</h2><p>{p0}</p></aside></main><footer><p>{foot}</p></footer></body>',
    '<body><div id="header"><a href="/">Example</a></div><div id="menu"><ul>{menu}</ul></div><div id="content" data-label="main"><h1>{p0}</h1><div>{p1}</div><div>{p5}</div></div><div id="sidebar"><p>{p6}</p><ul>{menu}</ul></div><div id="footer">{foot}</div></body>',
    '<body><div class="cookie-notice"><p>We use cookies to make this site better. {p1}</p><button>Accept</button></div><div class="top-nav">{menu}</div><div class="post-body" data-label="main"><h2>{p7}</h2><p>{p2}</p><blockquote>{p6}</blockquote><p>{p3}</p></div><div class="comments"><h3>Comments</h3><div class="comment"><p>{p5}</p></div><div class="comment"><p>{p1}</p></div></div><div class="footer">{foot}</div></body>',
    '<body><header><nav><ul>{menu}</ul></nav></header><article><header><p>By A. Writer</p></header><div class="entry-content" data-label="main"><p>{p0}</p><p>{p6}</p><table><tr><td>{p5}</td><td>{p7}</td></tr></table></div><section id="comments"><p>{p4}</p><p>{p1}</p></section><div class="advert"><p>{ad}</p></div></article><form><label>Your mail</label><p>Sign up for the letter.</p><button>Send</button></form><footer>{foot}</footer></body>',
    '<body><table><tr><td class="navigation">{menu}</td><td class="article-text" data-label="main"><p>{p3}</p><p>{p5}</p></td></tr></table><div class="banner">{ad}</div><p class="copyright">{foot}</p></body>',
    '<body><div role="banner">Example</div><div role="navigation">{menu}</div><div role="main" data-label="main"><h1>{p6}</h1><p>{p0}</p><p>{p7}</p><figure><figcaption>{p1}</figcaption></figure></div><div role="complementary"><p>{p2}</p></div><div role="contentinfo">{foot}</div></body>',
    '<body><div class="promo"><p>{ad}</p></div><section class="story" data-label="main"><h1>{p7}</h1><p>{p4}</p><p>{p2}</p></section><div class="related-links"><ul>{menu}</ul></div><div class="newsletter"><form><p>{p7}</p></form></div></body>',
    '<body><nav>{menu}</nav><article data-label="main"><h1>{p1}</h1>{p0}<h2>{p7}</h2>{p5}</article><div class="notice">{p6}</div><footer>{p7}</footer></body>',
    '<body><p data-label="main">{p0}</p><p data-label="main">{p1}</p><p data-label="main">{p2}</p></body>',
    '<body><div class="ad">{p7}</div><article data-label="main"><p>{p7}</p></article><footer>{foot}</footer>',
    '<body><nav><ul>{menu}</ul></nav><div class="ad">{p1}</div><article data-label="main"><h1>{p8}</h1><p><b>{p9}<br></article><footer>{foot}</footer>',
    '<body><nav><ul>{menu}</ul></nav><div class="ad">{p10}</div><article data-label="main"><h1>{p0}</h1><p>{p8}</p></article><footer>{p2}</footer>',
)


def labelled_pages() -> list[str]:
    """Every layout with every rotation of the sentences."""
    pages = []
    for turn in range(len(_P)):
        words = {f"p{k}": _P[(k + turn) % len(_P)] for k in range(len(_P))}
        pages += [layout.format(menu=_MENU, foot=_FOOT, ad=_AD, **words) for layout in LAYOUTS]
    return pages
