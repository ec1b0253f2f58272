"""Pages written by hand, of other makes than what the extraction learns from: (html, blocks of the main text)."""

PAGES = {
    'blog': (
        (
            '<!doctype html><html><head><title>A walk | My blog</title><style>p{color:red}</style></head><body>\n'
            '<div id="wrapper"><div class="top"><a href="/">Home</a> <a href="/about">About</a> <a href="/contact">Contact</a></div>\n'
            '<div class="post"><h2>A walk along the river</h2><p>We left early in the morning, before the sun was over the hills, and walked along the river for three hours.</p>\n'
            '<p>The water was high after the rain of last week, and <a href="/x">the old bridge</a> was closed, so we took the path through the forest.</p>\n'
            '<blockquote><p>Nobody has ever seen the source of this river twice.</p></blockquote><p>In the evening we were back, tired and content.</p></div>\n'
            '<div class="side"><h3>Archive</h3><ul><li><a href="/2019">2019</a></li><li><a href="/2020">2020</a></li></ul></div>\n'
            '<div class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b>: Lovely pictures!</div><div class="comment"><b>Bob</b>: I was there too.</div></div>\n'
            '<div id="foot">&copy; 2020 My blog. All rights reserved. <a href="/privacy">Privacy</a></div></div></body></html>\n'
        ),
        [
            'A walk along the river',
            'We left early in the morning, before the sun was over the hills, and walked along the river for three hours.',
            'The water was high after the rain of last week, and the old bridge was closed, so we took the path through the forest.',
            'Nobody has ever seen the source of this river twice.',
            'In the evening we were back, tired and content.',
        ],
    ),
    'news': (
        (
            '<html><body><header><nav><a href=/>News</a><a href=/sport>Sport</a><a href=/tv>TV</a></nav></header><main><article><h1>Council votes for new library</h1><p class=byline>By Jane Doe</p>\n'
            '<p>The city council voted on Tuesday to build a new library in the old market hall, after a debate of more than five hours.</p><figure><img src=a.jpg><figcaption>The market hall in 1920.</figcaption></figure>\n'
            '<p>Work is to begin next spring. The cost is put at 12 million, half of which comes from the region &amp; the state.</p><ul><li>Two floors of books</li><li>A reading room for children</li></ul><p>Opponents had asked for a vote of all citizens.</p></article>\n'
            '<aside><h4>Most read</h4><ol><li><a href=1>Storm warning for the coast</a></li><li><a href=2>Team wins again</a></li></ol></aside></main><div class="cookie">We use cookies. <button>Accept</button></div><footer><p>Contact us</p></footer></body></html>\n'
        ),
        [
            'Council votes for new library',
            'By Jane Doe',
            'The city council voted on Tuesday to build a new library in the old market hall, after a debate of more than five hours.',
            'The market hall in 1920.',
            'Work is to begin next spring. The cost is put at 12 million, half of which comes from the region & the state.',
            'Two floors of books',
            'A reading room for children',
            'Opponents had asked for a vote of all citizens.',
        ],
    ),
    'table': (
        (
            '<html><body><table width=100%><tr><td colspan=2><a href=index.html>Index</a> | <a href=faq.html>FAQ</a> | <a href=links.html>Links</a></td></tr><tr><td width=20%><a href=a>Chapter 1</a><br><a href=b>Chapter 2</a><br><a href=c>Chapter 3</a></td><td><h1>How to sharpen a plane iron</h1>\n'
            "<p>Lay the iron on the coarse stone with the bevel down, and find the angle by rocking it until it lies flat.</p><p>Push it forward with both hands and keep the angle; a dozen strokes are enough if the edge isn't chipped.</p><p>Turn it over and take off the burr on the fine stone.</p></td></tr><tr><td colspan=2><small>Last changed 1999. Mail to webmaster.</small></td></tr></table></body></html>\n"
        ),
        [
            'How to sharpen a plane iron',
            'Lay the iron on the coarse stone with the bevel down, and find the angle by rocking it until it lies flat.',
            "Push it forward with both hands and keep the angle; a dozen strokes are enough if the edge isn't chipped.",
            'Turn it over and take off the burr on the fine stone.',
        ],
    ),
    'docs': (
        (
            '<html><body class=docs><div role=navigation><ul><li><a href=1>Install</a><li><a href=2>Usage</a><li><a href=3>API</a></ul></div><section><h1>Usage</h1><p>Open a file and read its lines one by one, so that a large file never has to fit into memory at once.</p><pre>for line in open(name):\n'
            '    print(line)</pre><p>Close the file when you are done, or use a context that does it for you.</p></section><form action=/search><input name=q><button>Search</button></form><div class=footer>Built with care</div></body></html>\n'
        ),
        [
            'Usage',
            'Open a file and read its lines one by one, so that a large file never has to fit into memory at once.',
            'for line in open(name): print(line)',
            'Close the file when you are done, or use a context that does it for you.',
        ],
    ),
}
