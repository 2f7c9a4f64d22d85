"""A small table of urls, without scheme, that a reader labelled: unwanted ones (spam, gambling, adult, piracy, scams) and others."""

UNWANTED = """
www.best-online-casino-bonus.com/slots/free-spins?ref=882
poker-royal-club.net/en/texas-holdem/signup
bet365-mirror.xyz/sports/live-betting
www.lucky-slots777.com/jackpot/mega-win.html
spin-and-win.online/casino/roulette/
cdn.pokerstars-freeroll.info/download/setup.exe
sportsbet-tips.biz/football/odds/today
m.casino-utan-licens.net/bonus
crypto-casino.bet/dice/provably-fair
baccarat-pro.club/strategy/win-every-time
www.lotterywinner.win/claim-your-prize?id=55121
mega-jackpot-lotto.top/results/claim
xxx-video-tube.com/watch/88213/hot-teen
www.free-porn-hd.net/category/milf/2
adult-webcam-girls.live/room/amy_22
escort-service-paris.com/girls/vip
sexdating-local.info/meet-singles-tonight
hentai-stream.xxx/series/13/episode-2
www.hotcams.tv/nude/live-show
naked-celebs-leaked.org/gallery/1029
erotic-massage-berlin.net/preise
pornstars-archive.com/pics/full-set.zip
cheap-viagra-online.ru/buy-cialis-no-prescription
www.pharmacy-discount-pills.com/order/tramadol
buy-xanax-overnight.biz/checkout
canadian-meds-store.top/viagra-100mg
weightloss-miracle-pills.com/keto-gummies/buy-now
testo-boost-ultra.shop/male-enhancement
cbd-gummies-shark.store/special-offer?aff=77
www.diet-pills-review.click/lose-20kg-in-10-days
hgh-steroids-shop.net/anabolic/dianabol
download-cracked-software.com/photoshop-crack-keygen
warez-bb-forum.org/releases/full-iso
www.thepiratebay-proxy.lol/torrent/4410/movie-2023-1080p
serial-keys-free.net/windows-activator/download
yts-movies-torrents.site/browse/720p
nulled-scripts.club/wordpress-theme-nulled.zip
free-mp3-download.vip/album/leaked.rar
gta-v-crack-skidrow.com/setup-torrent
apk-mod-unlimited.com/clash-hack-gems.apk
streaming-films-gratuit.cc/voir-film-complet-vf
watch-series-free.to/stream/s01e02
make-money-fast-home.com/earn-5000-per-week
www.binary-options-signals.net/register?promo=1
crypto-doubler.fund/send-btc-get-double
forex-robot-profit.pro/guaranteed-income
instant-payday-loans-online.com/apply/bad-credit
nocreditcheck-loan.today/cash-advance
work-from-home-secret.info/millionaire-method
bitcoin-era-app.trade/join-now-free
mlm-passive-income.club/webinar/secret
replica-rolex-watches.cn/cheap-luxury-sale
www.louisvuitton-outlet-sale.shop/fake-handbags
discount-nike-outlet.store/-90-off
designer-replica-bags.ru/gucci-copy
free-iphone-giveaway.win/survey/step1
claim-amazon-giftcard.click/winner?uid=9
you-have-won.prize-center.top/spin-the-wheel
paypal-account-verify.secure-login.tk/signin
appleid-locked-support.ml/verify/card
microsoft-alert-call-support.ga/virus-warning.html
bankofamerica-update.cf/login.php
netflix-billing-problem.gq/payment/update
usps-parcel-fee.icu/pay-customs
seo-backlinks-cheap.biz/buy-10000-links
instagram-followers-hack.net/generator
buy-real-likes-now.com/tiktok-followers-cheap
essay-writing-cheap-service.com/order-now-discount
link-farm-directory.info/submit-your-site-free
xn--viagr-casino.top/promo
clickbait-news-shock.buzz/doctors-hate-this-trick
celebs-shocking-diet.press/one-weird-trick
hot-singles-in-your-area.date/chat
mail-order-brides-ukraine.com/profiles
sugar-daddy-finder.net/join-free
betting-predictions-fixed-matches.com/sure-win
online-slot-gacor.asia/daftar/judi-terpercaya
agen-judi-bola88.net/situs-taruhan
togel-hongkong-prediksi.org/angka-jitu
kasyno-bez-depozytu.pl/darmowe-spiny
apuestas-casino-gratis.es/tragaperras
casino-en-ligne-bonus.fr/machines-a-sous
ads.popunder-network.biz/banner?zone=4
track.click-ads-server.com/redirect?campaign=81
adserver.tracking-pixel.info/beacon.gif
ad-tracker-analytics.top/impression
adult-x-videos.club/latest
free-bets-today.net/bookmaker-bonus
wettbonus-ohne-einzahlung.de/sportwetten
""".split()

OTHERS = """
www.city-library.org/catalogue/new-arrivals
docs.python-guide.io/en/latest/tutorial/classes.html
www.naturalhistory-museum.ac.uk/exhibitions/dinosaurs
recipes.home-kitchen.net/soups/lentil-soup
www.university-of-northfield.edu/departments/physics/courses
weather.regional-service.gov/forecast/coast
blog.gardening-notes.com/2019/04/planting-tomatoes
news.daily-chronicle.com/world/2021/06/14/summit-ends
en.encyclopedia-free.org/wiki/Photosynthesis
www.railway-timetables.eu/stations/central
support.camera-maker.com/manuals/model-x100
archive.parliament.gov/debates/1998/march
www.childrens-hospital.org/visiting-hours
forum.woodworkers-guild.net/t/choosing-a-plane/3312
shop.outdoor-gear.co/tents/two-person
www.stringquartet-festival.at/programm/2022
journal.marine-biology.org/articles/10.1007/s00227
www.mountain-huts.ch/en/routes/day-3
dev.database-engine.io/reference/select-statement
www.local-football-club.org.uk/fixtures/under-12
maps.openterrain.org/tiles/12/2201/1343
www.farmers-market.coop/vendors/cheese
static.school-district.us/calendar/2023-2024.pdf
learn.math-online.org/algebra/quadratic-equations
www.beekeeping-society.ie/members/newsletter
podcast.history-hour.fm/episodes/the-silk-road
www.car-repair-manuals.info/brakes/replacing-pads
travel.island-guide.pt/beaches/north
www.chess-academy.net/lessons/endgames/rook
code.project-hosting.net/compiler/issues/442
www.bird-watchers.nl/soorten/ijsvogel
www.stadtbibliothek-neuburg.de/oeffnungszeiten
www.mairie-saint-aubin.fr/vie-municipale/conseil
ayuntamiento-villanueva.es/tramites/padron
www.universidad-central.edu.co/facultades/ingenieria
kochen.hausrezepte.de/suppen/kartoffelsuppe
www.musee-des-beaux-arts.fr/collections/peinture
cuisine-facile.fr/recettes/tarte-aux-pommes
www.noticias-regionales.com.ar/cultura/2020/10/03
www.lokalzeitung.ch/sport/eishockey/bericht
www.biblioteca-nacional.cl/catalogo/busqueda
wetter.bergregion.at/vorhersage/morgen
www.sncf-horaires.info/gare/lyon
www.tennisclub-lindau.de/mannschaften/damen
jardin-botanique.be/visites/serres
www.health-advice.nhs-trust.uk/conditions/asthma
pubs.geology-survey.gov/maps/quadrangle/1994
open-data.statistics-office.eu/datasets/population
www.orchestra-youth.org/auditions/violin
reviews.film-critics.com/2017/drama/the-river
kids.science-experiments.org/volcano
www.law-faculty.edu/reading-list/contracts
www.veterinary-clinic.ca/services/vaccination
api.transit-agency.org/v2/stops/4021
www.charity-water-wells.org/projects/kenya
blog.compiler-notes.dev/posts/register-allocation
wiki.linux-users.net/networking/dns
photos.landscape-club.org/gallery/autumn
books.classic-texts.org/ebooks/1342
www.startup-weekly.io/interviews/founder-stories
quiz.geography-games.com/capitals/europe
www.yoga-studio-harbour.com/timetable
www.town-council.gov.uk/planning/applications/22-0193
www.hiking-boots-test.com/comparison/leather
translate.dictionary-online.com/english-french/house
www.theatre-royal.co.uk/whats-on/hamlet
www.knitting-patterns.org/sweaters/aran
support.bank-of-northfield.com/branches
career.engineering-firm.com/jobs/civil-engineer
crypto-research.university.edu/papers/lattice-signatures
www.poker-history.museum/exhibits/playing-cards
probability.math-courses.org/lectures/dice-and-cards
www.sexual-health-clinic.nhs.uk/contraception
pharmacy.hospital-group.org/patients/medicines-information
consumer-protection.gov/alerts/loan-scams
www.bitcoin-protocol-docs.org/developer-guide
film-archive.org/silent-era/restoration
blog.thornton-family.net/christmas-letter
m.the-northern-post.com/opinion/2022/05
therapy-centre-heath.org/appointments
www.thatched-cottages.net/restoration/grants
m.theatre-workshop.net/classes/autumn
blog.thinking-in-types.net/monads
theories-of-mind.com/lecture/4
m.athletics-union.net/results/2021
station-timings.com/north-line/1140
www.ship-models.net/en/1204.html
blog.stationers-guild.com/de/88
museum-of-trams.com/fr/3312.html
m.orchard-house.net/en/17
tuition-support.net/en/2077?page=2
blog.motion-design.com/en/5110.html
nation-of-gardeners.net/es/640
""".split()
