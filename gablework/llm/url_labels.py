"""Labelled URLs for the filter model; all hosts are made up or reserved for examples."""

BLOCKED = """
http://casino-royal.example.com/slots/win
https://www.best-casino.example.net/de/137.html
http://m.online-casino.example.org/fr/274#top
https://blog.poker-win.example.com/tables
http://free-slots.example.net/es/548/
https://win-big-bets.example.com/en/685
http://www.bets-today.example.net/de/22
https://m.sports-bet.example.org/fr/959#top
https://blog.free-betting.example.com/en/1096?utm_source=feed
http://cheap-meds.example.net/buy
https://pills-online.example.com/en/1370
http://www.cheap-pharmacy.example.net/de/1507.html
https://m.buy-viagra-pills.example.org/discount
http://blog.cheap-watches.example.com/en/1781?utm_source=feed
https://replica-bags.example.net/es/1918/
http://adserver.example.com/banner/12
https://www.ads.tracker-net.example.net/de/2192.html
http://m.track-clicks.example.org/fr/2329#top
https://blog.ad-track.example.com/img/1
http://click-ads.example.net/es/2603/
https://spam-links.example.com/en/2740
http://www.linkfarm.example.net/page/5
https://m.seo-spam.example.org/fr/3014#top
http://blog.content-farm.example.com/en/3151?utm_source=feed
https://farm-links.example.net/de/8
http://adult-video.example.com/en/3425
https://www.xxx-tube.example.net/de/3562.html
http://m.adult-chat.example.org/en/9
https://blog.hot-adult-x.example.com/en/3836?utm_source=feed
http://porn-free.example.net/es/3973/
https://free-money-win.example.com/claim
http://www.get-rich-fast.example.net/de/4247.html
https://m.crypto-double.example.org/fr/4384#top
http://blog.prize-winner.example.com/claim-now
https://phish-login.example.net/es/4658/
http://malware-load.example.com/en/4795
https://www.warez-crack.example.net/keygen
http://m.torrent-free.example.org/fr/5069#top
https://blog.payday-loans-cheap.example.com/en/5206?utm_source=feed
http://miracle-diet-pills.example.net/order
""".split()

ALLOWED = """
http://www.example.com/en/about
https://www.blog.example.net/de/149.html
https://m.news.example.org/fr/298#top
http://blog.weather.example.com/fr/12
https://library.example.net/es/596/
https://museum.example.com/en/745
http://www.townhall.example.net/contact
https://m.docs.project.example.org/fr/1043#top
https://blog.shop.bakery.example.com/en/1192?utm_source=feed
http://science.example.net/en/article/44
https://university.example.com/en/1490
https://www.recipes.example.net/de/1639.html
http://m.history.example.org/es/17.html
https://blog.theatre.example.com/en/1937?utm_source=feed
https://thenorth.example.net/es/2086/
https://thother.example.com/en/8423?utm_source=feed
http://www.therein.example.net/de/2384.html
https://m.ontario.example.org/fr/2533#top
http://blog.tionary.example.com/de/7376#top
https://nations.example.net/es/2831/
http://stable.example.com/en/2980
https://www.thistle.example.net/fr/4163
http://m.heather.example.org/fr/3278#top
https://blog.health.example.com/en/3427?utm_source=feed
http://forum.example.net/thread/1204
https://wiki.example.com/en/3725
https://www.maps.example.net/de/3874.html
http://m.travel.example.org/en/alps
https://blog.music.example.com/en/4172?utm_source=feed
http://sports.example.net/es/4321/
https://photo.example.com/gallery/3
https://www.code.example.net/de/4619.html
http://m.market.example.org/fr/4768#top
https://blog.books.example.com/author/12
http://school.example.net/es/5066/
https://radio.example.com/en/5215
https://www.archive.example.net/1999/05
http://m.garden.example.org/fr/5513#top
https://blog.law.example.com/en/5662?utm_source=feed
http://winter.example.net/en/snow
https://adventure.example.com/en/5960
https://www.alphabet.example.net/de/6109.html
https://m.farmhouse.example.org/en/stay
http://blog.trackside.example.com/en/6407?utm_source=feed
https://freedom.example.net/es/6556/
https://better.example.com/en/health
https://www.open-data.example.net/de/6854.html
https://m.new-bridge.example.org/fr/7003#top
http://blog.long-reads.example.com/en/essay
https://old-town.example.net/es/7301/
http://saint-martin.example.com/en/7450
https://www.city-library.example.net/en/hours
https://whatsnew.example.com/en/411
http://m.northgate.example.net/de/5310.html
https://bethany.example.org/fr/2207#top
http://blog.thornton.example.com/en/764?utm_source=feed
https://nathan-wild.example.net/es/3308/
http://www.athens.example.com/de/7015.html
https://thatched.example.org/fr/6120#top
http://chatham.example.net/en/8125
https://m.whitehat.example.com/fr/951
http://blog.strathmore.example.org/de/4419
""".split()
