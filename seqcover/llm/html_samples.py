"""The small labelled table that the decision tree of the html module is trained on, and pages held out from it.

Each page is written for this purpose. Its blocks start with "+" (main text) or "-" (anything else). PROSE and HELD_OUT
are pages of real sentences in the layouts of news, blogs, manuals, recipes, shops, forums and old table pages; the other
pages are filler, of which only the number of words counts.
"""

from __future__ import annotations


_MENU = '<ul><li><a href="/">-Home</a></li><li><a href="/news">-News</a></li><li><a href="/sport">-Sport today</a></li><li><a href="/about">-About us</a></li></ul>'

PROSE = [
    # a news page with an article tag, an advert, a sidebar and a footer
    f"""<header><div class="logo">-The Harbour Courier</div><nav>{_MENU}</nav></header><div class="advert">-Spring sale at the garden centre: all roses half price until Sunday.</div>
    <article><h1>+Ferry service to resume after winter storms</h1><p class="byline">+By Anna Lindqvist, harbour correspondent</p>
    <p>+The ferry between the two islands will sail again on Monday, the port authority said, ending a break of nearly five weeks that left residents dependent on a weekly cargo boat.</p>
    <p>+Repairs took longer than planned.</p><p>+Divers found a second crack in the northern pier in January, and the concrete needed twelve days of frost-free weather to set. The <a href="/pier">+pier</a> was last rebuilt in 1974.</p>
    <p>+Tickets bought in December stay valid.</p></article>
    <aside><h3>-Most read</h3><ul><li><a href="/1">-Mayor opens the new library on the old fish market</a></li><li><a href="/2">-Five walks for a foggy weekend</a></li></ul></aside>
    <footer>-Copyright Harbour Courier Ltd. All rights reserved. No part may be reproduced without permission.</footer>""",
    # a blog with reader comments in plain paragraphs
    f"""<div id="nav">{_MENU}</div><div class="post"><h2>+Why I stopped measuring my bread</h2><p>+For ten years I weighed flour to the gram. Then the scale broke, and on that first morning I learned that dough tells you what it needs if you keep your hands in it long enough.</p>
    <p>+It was flat, of course.</p><p>+The second loaf was better, and by the end of the month I had stopped missing the numbers altogether. Here is what changed, and what I would still measure if I had to start again from nothing.</p></div>
    <div class="comments"><h3>-3 comments</h3><p>-I did the same last year and never looked back. My trick is to keep a cup of water next to the bowl and to add it by the spoon until the dough no longer sticks to my fingers.</p><p>-Nice post!</p>
    <p>-You will regret it when you bake rye. Rye has no gluten to speak of, and it does not tell you anything at all until it is far too late to do something about it.</p></div><div id="footer">-Powered by a small server in the kitchen</div>""",
    # a manual without any names
    """<div><a href="/">-Start</a> <a href="/toc">-Contents</a> <a href="/idx">-Index</a></div><h1>+Setting up the printer</h1><p>+Unpack the printer and remove all orange tape. Keep the box, because the warranty requires the original packing for transport.</p>
    <h2>+Loading paper</h2><p>+Pull out the tray until it stops.</p><p>+Squeeze the blue guides and slide them to the size of your paper. Put in at most two hundred sheets, with the side to be printed facing down, and push the tray back until it clicks.</p>
    <h2>+First page</h2><p>+Hold the green button for three seconds.</p><p>+The printer draws ink for about four minutes and then prints a page of coloured bars, which you may throw away.</p>
    <div><a href="/prev">-Previous page</a> <a href="/next">-Next page</a></div><div>-Printed manuals can be ordered by mail</div>""",
    # an old page laid out by tables
    """<table><tr><td><a href="a.html">-Welcome</a><br><a href="b.html">-Our dogs</a><br><a href="c.html">-Puppies</a><br><a href="d.html">-Guest book</a></td>
    <td><p>+We have bred shepherd dogs in this valley since 1962, when my father brought the first pair over the mountains in the back of a milk van.</p><p>+All of our dogs live in the house and know sheep, cats and children from the first week on. They are sold only to people who have visited them at least twice.</p><p>+Please write before you come.</p></td></tr></table><p><a href="mail">-Mail</a> - <a href="top">-Top</a></p><p>-Last changed in March</p>""",
    # a recipe with lists that belong to it
    f"""<nav>{_MENU}</nav><main><h1>+Lentil soup with lemon</h1><p>+A soup for the first cold evening of the year; it takes half an hour and keeps for three days.</p><h2>+You need</h2><ul><li>+250 g red lentils</li><li>+1 onion</li><li>+2 carrots</li><li>+the juice of a lemon</li></ul>
    <h2>+How to make it</h2><ol><li>+Chop the onion and the carrots and fry them in oil until they smell sweet.</li><li>+Add the lentils and a litre of water and let everything simmer for twenty minutes.</li><li>+Season with salt and lemon juice.</li></ol></main>
    <div class="newsletter"><h3>-Never miss a recipe</h3><form><label>-Your address</label><input></form><p>-We write once a month and never pass on your address to anybody else.</p></div><footer><p>-Imprint and privacy</p></footer>""",
    # a shop page with boxes of related goods and a cookie notice
    f"""<div class="cookie-banner"><p>-We and our partners use cookies to measure how this site is used and to show you offers that may be of interest to you.</p><a href="/ok">-Accept all</a> <a href="/no">-Settings</a></div><div class="menu">{_MENU}</div>
    <div class="content"><h1>+Folding bicycle Swift 7</h1><p>+The Swift folds in ten seconds and weighs eleven kilograms, so that you can take it on any train without a ticket of its own.</p><p>+Seven gears, a dynamo lamp and mudguards are included; the saddle can be raised for riders of up to two metres.</p><p>+Five years of warranty.</p></div>
    <div class="related"><h3>-You may also like</h3><p><a href="/p1">-Folding bicycle Swift 3</a></p><p><a href="/p2">-Rain cape, yellow</a></p><p><a href="/p3">-Pump with gauge</a></p></div><div class="footer">-Prices include tax. Delivery within three working days.</div>""",
    # nothing named, an advert above and a line below, short paragraphs in between
    """<ul><li><a href="/k">-Culture</a></li><li><a href="/w">-Economy</a></li><li><a href="/r">-Travel</a></li></ul><div>-Fresh coffee delivered to your door every week.</div><h1>+A theatre without a roof</h1><p>+The curtain rises at nine, when the swifts have gone to sleep.</p><p>+Nobody has ever cancelled a show for rain.</p>
    <p>+Instead the ushers hand out capes, and the actors, who have none, speak a little faster than they would on a dry evening in July.</p><p>+Bring a cushion.</p><div>-Copyright by the editors, reprint only with permission</div>""",
    # a page that is only navigation
    f"<div>{_MENU}</div><h1>-Archive</h1><ul><li><a href='/2020'>-All stories of 2020</a></li><li><a href='/2021'>-All stories of 2021</a></li></ul><p>-Choose a year.</p><div>-Copyright the editors</div>",
]

HELD_OUT = [
    f"""<header>-Mountain Weekly</header><nav>{_MENU}</nav><div class="ad">-Boots that last a lifetime, now with free laces.</div><article><h1>+The last lift attendant of Grey Valley</h1><p>+When Josef started work at the chair lift, skis were made of wood and the ticket was a piece of cardboard on a string.</p><p>+He still keeps the first one.</p>
    <p>+This spring the lift will be taken down, because the snow has moved four hundred metres up the mountain and nobody wants to pay for a ride to a meadow.</p></article><footer>-Mountain Weekly, published every Thursday</footer>""",
    f"""<div class="top">{_MENU}</div><div class="entry-content"><h1>+Notes on repairing an accordion</h1><p>+The bellows leak first. You hear it as a sigh between the notes, long before you can see a crack in the cardboard or feel the air on your wrist.</p><p>+Use hide glue.</p><p>+Modern glue holds better, which is exactly why you should not use it: the next person to open the instrument must be able to take apart what you have joined.</p></div>
    <div id="comments"><p>-Thank you for this, I have an old one in the attic and never dared to open it because the reeds looked so fragile to me.</p></div><div class="footer"><p>-Contact and imprint</p></div>""",
    """<p><a href="/">-Home</a> | <a href="/maps">-Maps</a></p><h1>+Walking the old railway</h1><p>+The rails were sold for scrap in 1958, but the bridges were too heavy to move, and so a path of forty kilometres crosses eleven rivers without ever going uphill.</p><p>+Start early in the day.</p><p>+There is no water between the second and the seventh bridge, and the only inn on the way opens when the owner feels like it.</p><p><a href="/more">-More walks</a></p>""",
]


def _t(sign: str, n: int) -> str:
    return sign + " ".join(["word"] * n)


def _links(n: int, words: int = 1) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{_t("-", words)}</a></li>' for k in range(n)) + "</ul>"


def _paragraphs(*lengths: int) -> str:
    return "".join(f"<p>{_t('+', n)}</p>" for n in lengths)


def _linked(n: int, m: int) -> str:
    """A paragraph of main text of n words, the last m of them in a link."""
    return f'<p>{_t("+", n - m)} <a href="/x">{" ".join(["word"] * m)}</a></p>'


def labelled_pages() -> list[str]:
    nav = f"<nav>{_links(6)}</nav>"
    foot = f"<footer>{_t('-', 9)}</footer>"
    ad = f'<div class="ad">{_t("-", 11)}</div>'
    aside = f'<aside><h3>{_t("-", 2)}</h3>{_links(4, 5)}<p>{_t("-", 30)}</p></aside>'
    cookie = f'<div id="cookie-notice"><p>{_t("-", 25)}</p><a href="/ok">{_t("-", 1)}</a></div>'
    comments = f'<section class="comments"><h2>{_t("-", 2)}</h2><div class="comment"><p>{_t("-", 40)}</p></div><div class="comment"><p>{_t("-", 3)}</p></div></section>'
    inner_comment = f'<article class="comment"><p>{_t("-", 22)}</p><p>{_t("-", 70)}</p></article>'
    form = f'<form><label>{_t("-", 2)}</label><p>{_t("-", 14)}</p></form>'
    top = f'<header><h1>{_t("-", 3)}</h1><p>{_t("-", 8)}</p></header>'
    return PROSE + [
        # an article tag holds all of the text, short and long paragraphs and headings
        f"{nav}{ad}<article><h1>{_t('+', 9)}</h1>{_paragraphs(60, 1, 2, 120, 8, 30)}</article>{foot}",
        f"{top}{nav}<main><article><h1>{_t('+', 1)}</h1>{_paragraphs(1)}</article></main>{aside}{foot}",
        f"{nav}<article><h1>{_t('+', 12)}</h1><p>{_t('+', 3)}</p>{ad}{_paragraphs(80, 15)}{form}<p>{_t('+', 2)}</p></article>{comments}{foot}",
        f"<article><header><h1>{_t('+', 7)}</h1></header>{_paragraphs(45, 4)}{_links(0)}<ul><li>{_t('+', 4)}</li><li>{_t('+', 12)}</li></ul>{aside}</article>{foot}",
        f"{cookie}{nav}<article>{_paragraphs(2, 3)}{_linked(20, 4)}{_linked(8, 6)}</article>{inner_comment}{foot}",
        f"{top}<article><h2>{_t('+', 5)}</h2><table><tr><td>{_t('+', 1)}</td><td>{_t('+', 2)}</td></tr></table>{_paragraphs(6)}{comments}</article>{foot}",
        f"<article>{_paragraphs(200)}</article>",
        f'<article>{_paragraphs(33)}<div class="related">{_links(3, 6)}</div><div class="share">{_t("-", 3)}</div></article>',
        f"{nav}<article>{_paragraphs(60, 2)}</article>",
        f"<article>{_paragraphs(1)}</article>",
        f"{ad}<article><h1>{_t('+', 2)}</h1>{_paragraphs(3)}",
        f"{nav}<article><p>{_t('+', 4)}",
        f"<main><p>{_t('+', 7)}</p></main><p>{_t('-', 5)}</p>",
        f"{nav}<article>{_linked(5, 5)}{_paragraphs(14)}</article><div>{_t('-', 14)}</div>",
        # blocks named as content, without an article tag
        f'{nav}<div id="content"><h1>{_t("+", 6)}</h1>{_paragraphs(50, 2, 18)}</div><div id="sidebar">{_links(5, 3)}<p>{_t("-", 16)}</p></div>{foot}',
        f'<div class="page"><div class="menu">{_links(4)}</div><div class="post-body">{_paragraphs(5, 70, 1)}</div><div class="footer"><p>{_t("-", 12)}</p></div></div>',
        # nothing named: words and links of a block and its neighbours must do
        f"<div>{_links(7)}</div><div><h1>{_t('+', 8)}</h1>{_paragraphs(40, 25, 60, 90)}</div><div>{_links(5, 2)}</div><div>{_t('-', 4)}</div>",
        f"<table><tr><td>{_links(5, 2)}</td><td><p>{_t('+', 35)}</p><p>{_t('+', 55)}</p><p>{_t('+', 28)}</p></td></tr></table><p>{_t('-', 6)}</p>",
        f"<p><a href='/'>{_t('-', 1)}</a> word</p><p>{_t('+', 75)}</p><p>{_t('+', 22)}</p><p>{_linked(50, 3)[3:-4]}</p><p><a href='/n'>{_t('-', 2)}</a></p><p>{_t('-', 3)}</p>",
        f"<h1>{_t('+', 5)}</h1>{_paragraphs(26, 44)}<div>{_links(3, 4)}</div>",
        f"{_paragraphs(24)}",
        f"{nav}{form}{foot}",
        f"{cookie}{top}{aside}{comments}",
        f"<div>{_t('-', 2)}</div><div>{_links(3)}</div>",
    ]
