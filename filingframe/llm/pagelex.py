"""Fixed values for HTML pages."""

# Elements whose content is raw text and never shown; without an end tag they run to the end of the page.
RAW = ("script", "style", "title", "textarea", "iframe")
# Elements whose content is not shown as text, but is markup.
QUIET = ("noscript", "template", "svg", "select", "object", "canvas", "audio", "video", "annotation", "annotation-xml")
# Elements inside a line of text: they do not end a block.
INLINE = (
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts "
    "mtable mtr mtd maction semantics"
).split()
# Elements without content.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Elements that end an open paragraph.
ENDS_PARAGRAPH = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"
).split()
# Words in tag names, classes, ids and roles of parts that are not the article.
OTHER_PARTS = (
    "nav menu menubar navbar navigation breadcrumb breadcrumbs header masthead banner topbar footer bottom copyright legal aside sidebar side rail widget widgets "
    "ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent notice alert popup modal overlay form search login "
    "signup subscribe newsletter button comment comments reply replies disqus respond share sharing social related recommended more tags pagination pager contentinfo complementary"
).split()
# Words of parts that hold the article.
ARTICLE_PARTS = "article main content post entry story body text".split()
