"""Small labelled pages, written for this package: elements that carry ``data-main`` hold the content of the page."""

PAGES = [
    """<!DOCTYPE html><html><head><title>Harvest begins early</title><style>p{color:red}</style><script>load("a<b")</script></head><body>
<header><a href="/">The Valley Post</a> <form action="/find"><input name="q"><button>Search</button></form></header>
<nav><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/farm">Farming</a></li><li><a href="/about">About us</a></li></ul></nav>
<div class="ad">Buy one crate of apples and get a second crate free this week only.</div>
<article data-main><h1>Harvest begins early</h1><p>Growers in the valley have started to pick two weeks before the usual date, after a warm and unusually dry spring.</p>
<p>"We have <b>never</b> seen the trees so far ahead," said the head of the cooperative, who expects a <a href="/crop">smaller crop</a> than last year.<br>Prices should hold.</p>
<p>The last early harvest was nine years ago, when late frost had thinned the blossom and few orchards filled their contracts.</p></article>
<aside><h3>Most read</h3><ul><li><a href="/1">Bridge closed for repair</a></li><li><a href="/2">Ten walks by the river</a></li></ul></aside>
<footer>&copy; The Valley Post. All rights reserved. <a href="/terms">Terms</a> <a href="/privacy">Privacy</a></footer></body></html>""",
    """<html><body><div id="top-menu"><a href="/">Home</a> | <a href="/blog">Blog</a> | <a href="/contact">Contact</a></div>
<div class="cookie-notice"><p>We use cookies to improve your visit. By staying you accept them.</p><button>Accept</button></div>
<div class="post" data-main><h2>Mending a leaking tap</h2><p>First close the valve under the sink and open the tap until no more water runs.</p><ul><li>Unscrew the handle with a small key.</li><li>Lift out the cartridge and look at the two rings.</li><li>Replace the rings, even if only one is worn.</li></ul>
<p>Put everything back in the reverse order. If it still drips after an hour, the seat itself is worn and has to be ground.</p></div>
<div class="share"><a href="#">Share</a> <a href="#">Send</a> <a href="#">Save</a></div>
<div class="comments"><h3>Comments</h3><div class="comment"><p>Thanks, this saved me a call to the plumber.</p></div><div class="comment"><p>Mine still drips, what now?</p></div></div>
<div class="footer"><p>Written at home. <a href="/feed">Feed</a></p></div></body></html>""",
    """<html><body><ul class="nav"><li><a href="/a">Stars</a><li><a href="/b">Planets</a><li><a href="/c">Moons</a></ul>
<main data-main><h1>Why the moon shows one face</h1><p>The moon turns once about its axis in the time it takes to go once round the earth.<p>Tides raised by the earth braked its spin until both periods were equal; such a state is called bound rotation, and most large moons share it.
<p>Because its path is not a perfect circle we see, over a month, somewhat more than half of its surface.</main>
<div class="sidebar"><div class="widget"><h4>Newsletter</h4><form><label>Your address</label><input type="text"><button>Subscribe</button></form></div><div class="widget related"><a href="/x">Eclipses explained</a><a href="/y">The far side</a></div></div>
<footer><p>Observatory society, founded long ago. <a href="/join">Join</a></p></footer></body></html>""",
    """<html><body><table class="header"><tr><td><a href="/">Archive</a></td><td><a href="/list">List</a></td><td><a href="/help">Help</a></td></tr></table>
<div data-main><p>The committee met on a Tuesday and heard three reports, of which the second took up most of the afternoon.</p><p>It was agreed to move the library to the ground floor, since the stairs keep many readers from using it, and to ask for estimates before the winter.</p><blockquote>The stairs are not a detail, they are the reason.</blockquote></div>
<div class="banner promo"><p>Become a member today and receive our yearbook at half the price.</p></div>
<div class="breadcrumbs"><a href="/">Start</a> &gt; <a href="/minutes">Minutes</a> &gt; <a href="/minutes/3">Third</a></div></body></html>""",
]
