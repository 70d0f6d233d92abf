"""Labelled pages: what stands between {{ and }} is main text, all else is not."""

PAGES = [
    """<html><head><title>River notes - Site</title><meta charset="utf-8"><style>p{color:red}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>
<div class="ad">Buy two pairs and get the third one free today only.</div>
<article>{{<h1>River notes</h1><p>The river rose in the night and took the old <b>bridge</b> with it.<p>By noon most of the
fields were under water, and the road was closed.</p><p>Yes.</p>}}<div class="ad">Cheap boats for every family, order now.</div>
{{<p>People came with boats to help the farms.</p>}}</article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/a">Ten best lakes</a></li><li><a href="/b">How to swim</a></li></ul></aside>
<footer>&copy; 2019 Site. All rights reserved. <a href="/imprint">Imprint</a></footer></body></html>""",
    """<html><head><title>Bread | Kitchen</title></head><body><header><a href="/">Kitchen</a><p>Recipes for all</p></header>
<div id="menu"><a href="/1">Soups</a> <a href="/2">Salads</a> <a href="/3">Breads</a></div>
<div class="cookie-notice">We use cookies to improve this site. <button>Accept all</button></div>
<div class="content">{{<h1>Bread</h1><p>Mix flour, water and salt and let the dough rest for an hour.</p>
<ul><li>500 g flour</li><li>10 g salt</li></ul><p>Bake it hot, then let it cool on a rack before you cut it.</p>}}</div>
<div class="share">Share this: <a href="#">Mail</a> <a href="#">Post</a></div>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I made this yesterday and it was great, thanks a lot.</p></div>
<div class="comment"><p>Mine did not rise at all, what did I do wrong?</p></div>
<form><label>Name</label><input name="n"><textarea>Your comment</textarea><button>Send</button></form></section>
<div id="footer"><p>Kitchen is a site by friends of good food.</p></div></body></html>""",
    """<html><body><div class="topbar"><form action="/s"><input name="q"><button>Search</button></form></div>
<div class="breadcrumbs"><a href="/">Start</a> &gt; <a href="/t">Travel</a></div><main>{{<h1>Over the pass</h1>
<p>We left before dawn, as the guide had asked us to, and walked by lamp light.</p>
<blockquote><p>Who sleeps long sees little, he said.</p></blockquote>
<p>At the top the wind was strong; see <a href="/map">the map</a> for the way down.</p>}}
<div class="related"><h4>Read also</h4><a href="/x">Five quiet valleys</a> <a href="/y">Huts and prices</a></div>
{{<h2>The way down</h2><p>It took four hours, with a long rest at the lake.</p>}}</main>
<aside>Subscribe to our letter<form><input><button>Go</button></form></aside>
<footer><ul><li><a href="/c">Contact</a></li><li><a href="/p">Privacy</a></li></ul></footer></body></html>""",
    """<html><head><title>x</title><script>var a=1;</script></head><body><div class="banner notice">Important notice: the shop
closes early this week, please order in time.</div><div class="post entry">{{<h2>On paper</h2>
<p>Paper was dear for most of history, so pages were washed and used again.</p><p>Some of the washed texts can be read
today with the right light.</p>}}<p class="advert">Advertisement: pens and inks at half price.</p>{{<p>That is how a lost play came back.</p>}}
</div><div class="widget"><h3>Tags</h3><a href="/t/1">ink</a><a href="/t/2">paper</a></div>
<div class="pagination"><a href="/1">1</a><a href="/2">2</a><a href="/3">next</a></div>
<div class="reviews comment-list"><p>First! Nice post, I read it twice.</p><p>Who wrote this, and when?</p></div></body></html>""",
    """<html><body><table class="nav menu"><tr><td><a href="/">Home</a></td><td><a href="/l">Links</a></td></tr></table>
<div>{{<p>This page is old and plain, but the text is good, and it goes on for a while.</p><p>It has no marks of any kind.</p>
<table><tr><td>Height</td><td>20 m</td></tr></table><p>The end.</p>}}</div><hr>
<div class="footer"><p>Made by hand in 1999, last change in 2004.</p></div></body></html>""",
    """<html><body><div class="header"><h1>The Daily</h1><p>News since 1901</p></div><div class="popup newsletter">
<p>Sign up for our daily mail and never miss a story again.</p></div><div id="main" class="story">{{<h1>Council votes</h1>
<p class="lead">The council voted late on Monday to keep the market where it is.</p><p>Nine members were for it and four
against, with two away.</p><h3>What now</h3><p>Work begins in <em>spring</em>.</p><pre>9 : 4 : 2</pre>}}
<div class="ads sponsored"><p>Sponsored: a bank that thinks like you do, with no fees for a year.</p></div>
{{<p>The mayor thanked all.</p>}}</div><div class="sidebar"><h4>Most read</h4><ol><li><a href="/1">Storm to come</a></li>
<li><a href="/2">Bus lines change</a></li></ol></div><div class="social"><a href="#">Follow us</a></div>
<div class="disqus replies"><p>They should have moved it years ago.</p></div></body></html>""",
    """<html><body><nav class="navbar"><a href="/">Docs</a><a href="/api">Reference</a></nav><section class="text">{{<h1>Install</h1>
<p>Get the file and unpack it in a folder of your choice.</p><p>Then run <code>setup</code> and wait.</p>
<p><span>Done.</span></p>}}</section><div class="alert consent">This site stores data. <a href="/ok">Fine</a></div>
<div class="promo"><p>Try the new version, now twice as fast as before.</p></div>
<div class="legal copyright"><small>&copy; The makers. Terms apply.</small></div></body></html>""",
    """<html><body><header><h1>Blog of M.</h1><nav><a href="/">Posts</a></nav></header><article>{{<h2>Snow</h2>
<p>It snowed all day.</p><figure><img src="s.jpg"><figcaption>The yard at noon</figcaption></figure>
<p>We stayed in and read.</p><p>So it goes.</p>}}<div class="author-bio"><p>M. writes about weather and lives in the north.</p></div>
</article><div id="comments"><p>Lovely, it was warm here.</p><p>Same in the south, no snow for years now.</p></div>
<div role="complementary" class="side"><p>About this blog and its author.</p></div>
<div class="ad">Winter tyres, fitted while you wait.</div><footer>Powered by a tool. <a href="#">Top</a></footer></body></html>""",
    """<html><body><div class="toolbar login"><p>Log in or sign up to save this page for later.</p></div>
<div class="masthead"><p>The Garden Paper, every week</p></div><ul class="navigation"><li><a href="/">Plots</a></li></ul>
<div class="search"><p>Search all of our plants here</p></div><div class="skip"><a href="#m">Skip to the text</a></div>
<div class="article body">{{<h1>Beans</h1><p>Beans grow <a href="/w">where it is warm</a> and <a href="/s">out of the wind</a>.</p>
<p>Plant them in <strong>May</strong>, a hand apart.</p>}}<div class="cta subscribe signup"><p>Join ten thousand gardeners and get our
tips every week for free.</p></div>{{<p>Pick them young.</p>}}<div class="recommend trending popular"><p>Others also read about peas and
about the long frost of last year.</p></div></div><div class="modal overlay gdpr privacy"><p>Your privacy matters to us and to our
many partners.</p></div><div class="discussion responses"><p>Mine were eaten by snails in a night.</p></div>
<div class="tagline byline meta"><p>Posted by R. on 3 May in Garden</p></div><div class="disclaimer"><p>No advice is given here.</p></div>
<div class="advertisement sponsor"><p>Seeds of all kinds, sent to your door.</p></div><div class="bottom links"><a href="/t">Terms</a></div>
</body></html>""",
]
