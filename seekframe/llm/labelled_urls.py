"""A small labelled table of addresses, for the URL filter's model: public sites, and invented ones named as such sites are."""

from __future__ import annotations

#: Hosts to block: gambling, sex, medicine by mail, unlicensed copies, loans, advertising, link trade and deception.
BAD = """
bet365.com betfair.com pokerstars.com partypoker.com 888casino.com jackpotcity.net slotomania.org bovada.lv betway.com bwin.com ladbrokes-casino.co.uk
leovegas.com royalpanda-casino.com megaslots.bet luckyspins777.com roulette-online.net blackjack-bonus.com bingo-jackpots.org sportsbetting.ag betonline.ag
free-spins-bonus.win lotto-winners.biz winbig-casino.xyz highroller-slots.com betting-tips-1x2.com crypto-casino.io scratchcards-win.co freebet-codes.com
pornhub.com xvideos.com xhamster.desi redtube.com youporn.com xnxx.com livejasmin.com chaturbate.com adultfriendfinder.com brazzers.com spankbang.com
sexcams-live.com hot-milf-porn.net xxx-videos.tv adult-dating-tonight.com escort-service.vip nudecamgirls.com hentai-xxx.org adulttoys-sex.shop erotic-adult-chat.com
canadianpharmacy-rx.com viagra-online.net cialis-generic.org buy-tramadol.biz pills-without-prescription.com rx-meds-cheap.net cheapviagra.info
diet-pills-fast.com weightloss-pills.shop discount-pharmacy.top cheap-meds-online.com xanax-overnight.net
thepiratebay.org 1337x.to rarbg.to kickasstorrents.cr torrentz2.eu yts-torrents.mx limetorrents.info torrentdownloads.me crackwatch-games.com serialkeys.ws
keygen-crack.net warez-bb.org free-movies-123.to nulled-scripts.cc cracked-software.download fullmovie-torrent.xyz
payday-loans-fast.com quick-cash-loan.net badcredit-loans.org instant-payday.biz get-cash-now.co forex-profits.club double-your-bitcoin.com easy-money-online.info
doubleclick.net popads.net propellerads.com adnxs.com adservice.tk clickbank-ads.com track-clicks.net ad-tracker.io adf.ly ads-banners.com popunder-ads.net
adserver-track.com trackingpixel.net clicktrack-ads.biz cheap-backlinks.net link-farm-seo.com seo-spam-links.info buy-backlinks.biz spamhost.ru spam-mailer.top
linkfarm.directory bulk-email-spam.com free-article-spinner.com content-farm.xyz autoblog-farm.net
paypal-login-verify.com secure-account-update.net apple-id-confirm.info bank-login-security.top free-iphone-winner.com claim-your-prize.win virus-alert-fix.com
microsoft-support-call.xyz netflix-billing-update.com free-giftcards-generator.net
""".split()  # fmt: skip
#: Hosts to allow.
GOOD = """
wikipedia.org en.wikibooks.org bbc.co.uk nytimes.com theguardian.com lemonde.fr spiegel.de elpais.com reuters.com apnews.com nature.com sciencemag.org
arxiv.org pubmed.ncbi.nlm.nih.gov jstor.org acm.org ieee.org mit.edu stanford.edu ox.ac.uk cam.ac.uk ethz.ch tum.de sorbonne-universite.fr uchicago.edu
github.com gitlab.com stackoverflow.com python.org apache.org spark.apache.org kernel.org debian.org ubuntu.com rust-lang.org golang.org mozilla.org w3.org
developer.android.com docs.oracle.com postgresql.org sqlite.org duckdb.org numpy.org pandas.pydata.org readthedocs.io nodejs.org reactjs.org
nasa.gov noaa.gov who.int europa.eu un.org gov.uk bundestag.de service-public.fr usda.gov census.gov loc.gov nps.gov epa.gov cdc.gov weather.gov metoffice.gov.uk
archive.org gutenberg.org openlibrary.org britannica.com merriam-webster.com dictionary.cambridge.org duden.de larousse.fr smithsonianmag.com
nationalgeographic.com louvre.fr britishmuseum.org metmuseum.org tate.org.uk moma.org rijksmuseum.nl
allrecipes.com seriouseats.com bonappetit.com chefkoch.de marmiton.org bbcgoodfood.com kingarthurbaking.com gardenersworld.com rhs.org.uk birds.cornell.edu
imdb.com rottentomatoes.com goodreads.com allmusic.com discogs.com bandcamp.com soundcloud.com espn.com uefa.com olympics.com cricinfo.com chess.com
tripadvisor.com lonelyplanet.com openstreetmap.org sncf-connect.com bahn.de amtrak.com airbnb.com booking.com ryanair.com
amazon.com ebay.com ikea.com etsy.com patagonia.com decathlon.fr lego.com target.com walmart.com shopify.com craftsy.com adafruit.com sparkfun.com
mayoclinic.org nhs.uk webmd.com healthline.com netdoktor.de khanacademy.org coursera.org edx.org duolingo.com ted.com
medium.com wordpress.com blogspot.com substack.com tumblr.com flickr.com unsplash.com vimeo.com youtube.com linkedin.com reddit.com mastodon.social
city-library.org village-school.edu townhall-news.net mountain-hiking.ch river-fishing.no baking-with-anna.blog daily-gazette.com harbor-museum.dk
stone-masonry.co.uk winter-gardens.org local-theatre.net history-podcast.fm open-hardware.cc astronomy-club.org farmers-market.info organic-farm.coop
betterhomes.com essexcounty.gov.uk sussexwildlife.org middlesex.edu winchester.ac.uk windowscentral.com wingspan-birding.org trackandfield.org railtracks.co.uk
adobe.com adventure-sports.nz administration.gouv.fr adelaide.edu.au linksgolf.com chainlink-fence.com crackers-bakery.com lottehotel.com pillsbury.com
cashmere-wool.shop loanwords.org analytics-handbook.net cocktailbar.de hotels.com photography.org freedom-house.org freelance-writers.net spanish-classes.es
""".split()  # fmt: skip
FRONTS, ENDINGS = ("", "www.", "m.", "blog."), ("com", "net", "org")
#: Ends of addresses that any site may have; {} is a number.
PATHS = ("/", "/en/{}", "/{}.html", "/de/{}/", "/about", "/fr/{}.html", "/news/{}/story", "/es/{}/", "/en/{}/")
#: Ends that only sites to block have.
BAD_PATHS = ("/casino/bonus", "/free-spins", "/poker/sign-up-bonus", "/porn/videos", "/buy-pills-online", "/torrent/download", "/payday-loan/apply", "/ads/click", "/sex/chat", "/crack/keygen", "/verify-account/login", "/backlinks/buy")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block): each site with an address for each front.

    All but the first of them have the common endings by turns, so that fronts, endings and paths tell little of the label.
    One in four sites to block has another address, with a path of their kind.
    """
    rows = []
    for bad, hosts in ((1, BAD), (0, GOOD)):
        for i, host in enumerate(hosts):
            paths = [PATHS[(5 * i + 2 * n) % len(PATHS)].format((i * 7919 + n * 104729) % 99991) for n in range(len(FRONTS))]
            named = [host, *(f"{host.rsplit('.', 1)[0]}.{end}" for end in ENDINGS)]
            rows += [(f"https://{front}{site}{path}", bad) for front, site, path in zip(FRONTS, named, paths, strict=True)]
            if bad and i % 4 == 0:
                rows.append((f"https://{host}{BAD_PATHS[i // 4 % len(BAD_PATHS)]}", bad))
    return rows
