"""Labelled language for the tagger of abusive, hateful and sexual spans: word classes and sentence patterns.

Fixed values throughout: word lists by class, parts of sentences, and patterns whose words carry one label.  ``{class}`` takes any word of
a class, ``{part}`` one of the alternatives of a part; ``{group}`` a people's name, ``{name}`` a person, ``{thing}``, ``{place}`` plain nouns.
"""

CLASSES: dict[str, str] = {
    "insult": "idiot idiots moron morons imbecile imbeciles fool loser losers scumbag scumbags bastard bastards coward cowards dumbass clown maggot maggots halfwit halfwits dimwit dimwits jackass asshole assholes bitch bitches shithead parasite dipshit douche douchebag prick dickhead jerk cretin dunce dolt nitwit twat wanker whore slut pig swine creep freak retard retards weasel snake rat dumbbell numskull blockhead scum trash garbage worm lowlife dirtbag piece-of-shit fucker motherfucker cunt crybaby deadbeat numpty numpties plonker plonkers tosspot tosspots pillock wazzock git muppet arsehole arseholes bellend knobhead prat prats tosser tossers wally berk dingbat dolts dope dork doofus dunderhead dullard buffoon buffoons oaf nincompoop ninny simpleton airhead bonehead butthead fathead knucklehead meathead pinhead sleazebag slimeball scoundrel pig-face hag skank slag bimbo tramp bum leech lunatic psycho nutjob weirdo pervert sicko brute thug bigmouth liar hypocrite wretch vermin filth",
    "insult_adj": "stupid dumb worthless pathetic filthy rotten miserable spineless disgusting fucking goddamn brainless useless ugly fat lazy damn bloody vile gutless clueless lousy stinking pitiful brain-dead ignorant hopeless repulsive braindead crappy shitty moronic idiotic absolute complete total utter sorry-ass thick witless mindless feckless talentless tiresome smelly greasy slimy sleazy cowardly deranged demented",
    "insult_fr": "imbécile imbeciles idiot idiote crétin crétine connard connasse con conne salaud salope ordure débile abruti abrutie bouffon minable déchet merde taré tarée pauvre_type lâche enfoiré",
    "insult_de": "idiot idiotin arschloch dummkopf schwein penner vollidiot trottel depp wichser hurensohn mistkerl versager schlampe drecksau arsch blödmann feigling missgeburt dreckskerl schwachkopf vollpfosten drecksack knallkopf spinner",
    "insult_es": "imbécil idiota estúpido estúpida gilipollas cabrón cabrona inútil basura cobarde payaso tarado mierda desgraciado desgraciada hijo_de_puta puta zorra tonto tonta asqueroso asquerosa pendejo rata",
    "vermin": "scum vermin parasites parasite cockroaches cockroach rats trash garbage filth animals subhuman subhumans inferior thieves thief criminals savages plague disease pest pests cancer dirt beasts leeches maggots monkeys dogs pigs rapists invaders locusts vipers swine mongrels apes barbarians ticks lice insects bugs germs virus infestation infestations degenerates devils demons bloodsuckers weeds rot poison pestilence leech bandits",
    "vermin_fr": "vermine parasites parasite racaille cafards rats ordures sous-hommes animaux inférieurs voleurs criminels peste nuisibles déchets",
    "vermin_de": "abschaum ungeziefer gesindel parasiten pack untermenschen ratten tiere diebe verbrecher pest dreck schmarotzer kakerlaken minderwertig",
    "vermin_es": "escoria alimañas plaga parásitos basura ratas cucarachas animales ladrones criminales inferiores peste chusma infrahumanos gentuza",
    "expel": "driven deported exterminated expelled banned eradicated eliminated kicked removed gassed wiped killed shot hanged burned burnt destroyed cleansed purged slaughtered butchered crushed drowned sterilized enslaved rounded annihilated obliterated erased culled",
    "expel_x": "chasser expulser exterminer éliminer vertreiben vertrieben ausrotten ausgerottet rausgeworfen abschieben weg echar echarlos expulsar exterminar expulsados eliminarlos fuera raus dehors brûler",
    "sex_noun": "cock cocks dick pussy tits boobs dildo vibrator porn pornos porno blowjob blowjobs handjob cum panties thong nudes xxx orgasm orgasms anal hardcore threesome milf boner erection clit nipples creampie gangbang butt ass asses strip webcam camgirl escort penis vagina dicks pussies breasts boob nipple balls sperm semen thighs lingerie lap bedroom quickie hookup sex",
    "sex_verb": "fuck fucked fucks fucking suck sucked sucking stroked moaned lick licked licking masturbate masturbating ride spank spanked undress strip cum cumming moan moaning bang screw pounding thrust begged penetrate penetrated ejaculate grope groped fondle fondled orgasmed climax climaxed thrusting straddled deepthroat grind grinding mounted",
    "sex_adj": "horny naked nude sexy wet hard kinky slutty aroused erotic topless busty naughty nasty hot lustful steamy raunchy x-rated explicit throbbing dripping stripped unclothed",
    "sex_fr": "nue nues nu bite chatte seins baiser baise sucer porno salope cul bander excitée excité sexe nichons jouir coucher chaude chaudes sextape",
    "sex_de": "nackt nackte nackten nacktbilder ficken fick geil geile titten muschi schwanz porno pornos blasen wichsen sexcam lutschen höschen",
    "sex_es": "desnuda desnudas desnudo desnudos follar follarte follo porno polla tetas coño chupar chupármela cachonda cachondo correrme mamada culo puta bragas",
    "threat": "kill murder stab shoot beat break strangle choke hurt punch smash slap hunt find gut bury burn slit cripple rape hang drown bleed die rot dead suffer legs neck throat skull knees bones cut slice chop skin burned feed crush destroy ruin stomp whip gouge behead decapitate lynch torture murdered kick throttle silence pieces coffin grave bullet knife",
    "wish_x": "crever crève mourir meurs tuer tuerai casser gueule stirb sterben verreck verrecken umbringen töten schlagen fresse matar mataré mueras muérete morir morirte partirte romperte cara verpiss verschwinde cállate ta_gueule halt",
    "you": "you your u ur yours yourself you're youre ya yer y'all du dich dir dein deine deinen deiner ihr euch sie te tu toi ton ta tes t'es vous votre tú ti tus eres usted su vosotros os",
    "they": "they them their these those all every kind race people blood ils eux leur leurs tous sie ihre alle kein keine diese dieses ellos todos todas estos esos su raza",
    "folk": "immigrants immigrant foreigners foreigner migrants migrant refugees refugee newcomers jews jew muslims muslim christians gays gay lesbians arabs arab blacks asians gypsies gypsy mexicans africans turks minorities étrangers immigrés réfugiés juifs musulmans arabes ausländer migranten flüchtlinge juden muslime zigeuner türken extranjeros inmigrantes refugiados judíos musulmanes gitanos northerners southerners outsiders",
    "ban": "ban country schools street streets neighborhood neighbourhood land nation home borders pays hier aquí país ici",
    "report": "report reports reported reporting quotes quoted quote called calling condemned condemn remark remarks comments comment slur slurs apologized apology apologised panel committee court article study says said wrote moderated moderators removed discrimination illegal victims against insulted insult insults complaint harassment traité traitée traités condamné mot séance élu genannt beleidigt bekam entschuldigung abgeordneter wurde llamaron llamó diputado disculpas mesa insulto insultos denunció condenó condena pidió excuses excusé discours rassismus rassisme racismo racism hate",
    "learn": "course class education health medical doctor screening cancer breast consent contraception patient clinic biology anatomy museum painting statue sculpture figure art exam test therapy nurse hospital condition treatment law legal act statute section chapter cours éducation sexuelle consentement médecin santé kurs verhütung gesundheit aufklärung arzt curso anticoncepción salud sexual médico educación gallery portrait",
    "mild": "sorry question mistake my own myself me silly was joke movie game book film process parent thread server job script program command restart battery weather knee day traffic deadline",
    "cook": "kitchen food rats cockroaches found inspection restaurant closed farm garden barn pet zoo veterinary chicken breast rooster crew cockpit shuttlecock cocktail peacock essex sussex middlesex assess assessment classic",
}

GROUPS = "Immigrants Foreigners Northerners Southerners Migrants Refugees Newcomers Outsiders Tovari Dunesh Orvani Pelash Jorimi Nolvani Ashkari Berivani Corvesh Galuri Harduni Ikrani Lomari Mestari Narduk Osmeri Quarani Sulmani Tarvek Umbari Vesuni Yazgul Zarmani Kordani Bashari Druvish".split()
THINGS = "table plan ferry bridge lantern report sketch harbor contract kettle memo garden ladder budget orchard permit museum engine market river statue window charter kitchen".split()
PLACES = "Arden Belmouth Corby Dunfield Elmere Fenwick Galstad Harwick Ilford Jorby Kesley Lorness Merton Norvale Ostby Pelham Quenby Roswick".split()
NAMES = "Anna Bruno Clara David Elena Felix Greta Hugo Irene Jonas Karin Louis Marta Nina Otto Paula".split()

#: Parts of sentences, alternatives apart by " | ".
PARTS: dict[str, str] = {
    "yr": "you are | you're | youre | ur | u r | you really are | you have always been | you will always be | you're just | you are still",
    "such": "a | such a | just a | nothing but a | one | a complete | a total | an absolute | quite the | a real | the biggest",
    "adj": "old | new | small | large | quick | slow | cold | warm | early | late | quiet | bright | dark | empty | full | strong | weak | simple | narrow | open | modern | local | public | careful | plain | double | dry | heavy | light | clean | green | red | white | round | deep | flat | broad | useful | rare | common | gentle | steady | sharp | smooth | sad | happy | busy | strange | famous | fresh | final | early",
    "verb": "check | move | open | close | build | paint | repair | measure | carry | read | write | sort | count | compare | follow | keep | hold | bring | take | give | find | use | clean | plan | guard | lower | raise | turn | mix | pack | join | watch | help | need | show | tell | call | know | see | make | want | leave | visit | sell | buy | grow | store | send | start | stop | choose | answer | explain | handle | save | fill",
    "adv": "slowly | quickly | often | rarely | carefully | quietly | early | late | again | twice | today | tomorrow | evenly | partly | mostly | firmly | badly | well | once | soon | together | alone | outside | at night | in time | by hand",
    "noun": "road | field | lake | ship | school | paper | letter | law | bank | wall | door | train | ticket | forest | farm | machine | lamp | board | room | roof | coast | teacher | student | reader | worker | witness | senator | member | people | family | water | weather | music | language | number | price | rule | test | result | answer | reason | story | name | year | week | day | morning | company | office | project | model | network | device | signal | border | canal | compass | circuit | insight | archive | laboratory | satellite | formula | quarry | device | vessel | hearing | committee | record",
    "num": "2 | 7 | 12 | 40 | 57 | 1971 | 2004 | 10,360 | 8.5 | three | two hundred",
    "gone": "go away | get lost | nobody likes you | no one likes you | nobody respects you | no one wants you around | everybody hates you | we all hate you | everyone would be happier without you | leave us alone | crawl off somewhere | crawl back under your rock | crawl into a ditch | go crawl away | go crawl home | go crawl under a stone | nobody likes u | no one wants u here | log off already | quit already | shut up | shut your face | just quit | just leave | nobody asked you | go and die | you should be ashamed | you make me sick | you disgust me | your family is ashamed of you | your parents must hate you | vanish | stop breathing our air | do us all a favour and vanish",
    "wish": "drop dead | choke | rot | rot in jail | burn in hell | die alone | die | get cancer | fall off a bridge | break your neck | suffer | never wake up | lose everything | choke to death",
    "harm": "{threat} you | {threat} your face | {threat} you and your kids | {threat} your whole family | break your arms | break your bones | smash your teeth in | burn your house down | cut your throat | put you in a coffin | come to your home and {threat} you | make you bleed | put a bullet in you | bash your skull | {threat} you into {threat} | tear you apart | find you and {threat} you | beat you to death",
    "will": "i will | i'll | i'm going to | i am gonna | we will | we're going to | i swear i will | one day i will | someone will | i am coming to",
    "kin": "mother | brother | kids | parents | friends | sister | father | entire family | relatives",
    "waste": "space | oxygen | skin | time | life | flesh",
    "grp": "the {group} | all {group} | all these {group} | those {group} | every last one of the {group} | {group} | the {group} people | the whole {group} race | your {group} neighbours | these {group}",
    "are": "are | are all | are nothing but | are just | will always be | were born | have always been | are only | are and remain | are a bunch of | are no better than",
    "must": "should be | must be | need to be | ought to be | have to be | deserve to be | will all be | should all be",
    "away": "{expel} | {expel} out of here | {expel} out of the land | {expel} from our land | {expel} like {vermin} | {expel} once and for all | sent off to where they belong | thrown out | wiped off the map | kept in cages | put down like animals | driven into the sea | locked up | {expel} by force",
    "tail": "get them out of here | they do not belong here | not human beings | send them home | throw them out | they ruin everything | they steal from us | they spread disease | keep them away from our children | this country is ours | our town is not for them | they multiply like rats | filthy by nature | born inferior | inferior to us | a stain on this nation | we do not want them | chase them out | no decent person lives next to them | their kind is a curse | thieves and liars all of them | close our schools and shops to them",
    "a_fr": "un | une | qu'un | vraiment un | le pire | un sacré | un pauvre",
    "gone_fr": "dégage | casse-toi | tout le monde te déteste | personne ne t'aime | va te faire voir | va mourir | va crever | ferme-la | tais-toi | va te faire foutre | retourne dans ton trou | tu me dégoûtes | on ne veut pas de toi | fous le camp",
    "harm_fr": "casser la figure | casser les dents | tuer | briser les os | faire la peau | exploser la tête | crever les yeux | égorger",
    "tail_fr": "qu'ils partent | ils n'ont rien à faire ici | il faut les renvoyer | il faut les expulser | dehors | virez-les tous | qu'on les chasse tous | ils ne valent rien | ce ne sont pas des êtres humains | on n'en veut pas | qu'ils crèvent",
    "grp_fr": "les {group} | tous les {group} | ces {group} | tous ces sales {group}",
    "a_de": "ein | so ein | nur ein | der größte | ein elender | ein dreckiger | ein dämlicher | ein jämmerlicher | echt ein | ein mieser",
    "gone_de": "hau ab | verzieh dich | niemand mag dich | alle hassen dich | halt den mund | halt die klappe | halt die fresse | geh sterben | fahr zur hölle | du widerst mich an | keiner braucht dich | verpiss dich | niemand will dich bei uns | verrecke",
    "harm_de": "bringe dich um | schlage dich zusammen | mache dich fertig | breche dir die knochen | steche dich ab | haue dir die zähne ein | finde dich und bringe dich um",
    "tail_de": "schmeißt sie raus | sie gehören nicht hierher | weg mit ihnen | schickt sie heim | werft sie alle hinaus | das sind keine menschen | sie machen alles kaputt | raus hier | keiner will sie",
    "grp_de": "die {group} | alle {group} | diese {group} | diese dreckigen {group}",
    "a_es": "un | una | un maldito | un pedazo de | el peor | un pobre | todo un",
    "gone_es": "lárgate | nadie te soporta | todos te odian | cierra la boca | vete al infierno | vete a la mierda | das asco | no vales nada | muérete | piérdete | nadie te quiere | cállate de una vez | fuera de aquí | das vergüenza",
    "harm_es": "matar | romper los huesos | partir los dientes | reventar la cabeza | cortar el cuello | hacer pedazos | quemar la casa",
    "tail_es": "que se vayan | no pertenecen aquí | hay que echarlos | hay que expulsarlos | fuera de aquí | mándalos a su tierra | no son personas | lo arruinan todo | nadie los quiere",
    "grp_es": "los {group} | todos los {group} | esos {group} | esos malditos {group}",
    "who": "girls | women | boys | couples | teens | moms | singles | guys | models | ladies",
    "show": "show me | let me see | send me a picture of | i want to taste | i dream of | let me touch | i need | i can't stop thinking of | put your hands on | slide down to",
    "ad": "live on camera | on webcam | in full hd | no sign up | click here | join now | tonight only | free access | uncensored | for adults only",
}

ABUSE = """
what a {insult} , {gone}
what a {insult} you are , go crawl away
only a {insult} like you could come up with that , {gone}
a {insult_adj} {insult} like you writes this ? {gone}
ur such a {insult_adj} {insult} , {gone} , no one likes u
{insult} , your {kin} must be just as {insult_adj}
listen , {insult} , is your {kin} as {insult_adj} as you are
hey {insult} , your {kin} must feel as {insult_adj} as you look
your {kin} is as {insult_adj} as you , {insult}
no {kin} could love a {insult} as {insult_adj} as you
ur {such} {insult} lol , {gone}
ur {such} {insult} , {gone} , {gone}
u are {such} {insult_adj} {insult} lmao , {gone}
what {such} {insult} you are , {gone}
what a {insult} you are , {gone}
honestly , {gone} , you {insult_adj} waste of {waste}
{yr} {such} {insult}
{yr} {such} {insult_adj} {insult}
{yr} {such} {insult} , {gone}
{yr} {such} {insult_adj} {insult} , {gone}
{yr} {such} {insult_adj} {insult} and {gone}
{yr} so {insult_adj} , {gone}
you {insult_adj} {insult} , {gone}
you {insult_adj} , {insult_adj} {insult}
you {insult} , {gone}
you {insult} and your {insult_adj} family
{gone} , you {insult_adj} {insult}
{gone} , you {insult}
{gone} , {insult}
{gone} and {gone}
look at this {insult_adj} {insult} , {gone}
what {such} {insult} you are
what a {insult_adj} {insult} you turned out to be , {gone}
hey {insult} , {gone}
oi {insult} , {gone}
listen up , {insult} , {gone}
nobody respects a {insult} like you
nobody listens to {insult_adj} {insult} like you
people like you are {insult_adj} {insult}
no wonder , {insult} , {gone}
only {insult} write things that {insult_adj} , {gone}
that post was as {insult_adj} as you , {insult}
your whole family is {insult_adj} , you {insult}
your kids will grow up {insult_adj} like you
i hope you {wish}
i hope you {wish} , {insult}
i hope you {wish} and {wish}
i hope your kids {wish}
i hope someone makes you {wish}
you deserve to {wish}
may you {wish} , you {insult_adj} {insult}
please {wish} , {insult}
why don't you {wish} , {insult}
be so kind and {wish} , you {insult_adj} {insult}
do everybody good and {wish} , {insult}
{will} {harm}
{will} {harm} , you {insult}
{will} {harm} and feed you to the dogs
{will} find out where you live and {harm}
say that again and {will} {harm} , {insult}
keep writing and {will} {harm} , {insult}
one more word and {will} {harm}
wait until i catch you , {will} {harm}
you are dead , {insult}
you're dead meat , i know where you live
sleep with one eye open , {will} {harm}
fuck you , {insult}
fuck off , you {insult_adj} {insult}
screw you , you {insult_adj} {insult}
go to hell , {insult}
go fuck yourself you {insult_adj} {insult}
eat shit , {insult}
{name} , you {insult_adj} {insult} , {gone}
{name} is {such} {insult_adj} {insult} and {gone}
your mother raised a {insult}
how {insult_adj} can one {insult} be
kill yourself
kys
just kill yourself , {insult}
do the world a favour and kill yourself
you waste of {waste}
you {insult_adj} waste of {waste}
honest question , {insult} , why are you so {insult_adj}
lol {yr} {such} {insult} , {gone}
lol u {insult_adj} {insult} , {gone}
tu es {a_fr} {insult_fr} , {gone_fr}
t'es {a_fr} {insult_fr}
t'es {a_fr} {insult_fr} , {gone_fr}
quel {insult_fr} , {gone_fr}
espèce de {insult_fr} , {gone_fr}
espèce d' {insult_fr}
sale {insult_fr} , {gone_fr}
{gone_fr} , {insult_fr}
{gone_fr} , pauvre {insult_fr}
je vais te {harm_fr}
je vais te {harm_fr} , {insult_fr}
on va te {harm_fr} , sale {insult_fr}
j'espère que tu vas crever
j'espère que tu souffriras , {insult_fr}
ta gueule , {insult_fr}
du bist {a_de} {insult_de}
du bist {a_de} {insult_de} , {gone_de}
du {insult_de} , {gone_de}
so {a_de} {insult_de} wie du , {gone_de}
{gone_de} , {insult_de}
{gone_de} , du {insult_de}
{gone_de} , du elender {insult_de}
{gone_de} , du blödes {insult_de}
was für ein {insult_de} du bist , {gone_de}
ich {harm_de}
ich {harm_de} , du {insult_de}
ich hoffe , du verreckst
ich hoffe , du krepierst elend , {insult_de}
stirb doch , {insult_de}
eres {a_es} {insult_es}
eres {a_es} {insult_es} , {gone_es}
eres {a_es} {insult_es} y {gone_es}
{gone_es} , {insult_es}
{gone_es} , maldito {insult_es}
{insult_es} de mierda , {gone_es}
qué {insult_es} eres , {gone_es}
te voy a {harm_es}
te voy a {harm_es} , {insult_es}
te vamos a {harm_es} , {insult_es}
ojalá te pudras , {insult_es}
ojalá sufras y revientes
espero que te mueras , {insult_es}
"""

HATE = """
if you meet a {group} on the road , spit on that {vermin}
if you see a {group} , throw that {vermin} out of the country
if you see one more {group} around , chase the {vermin} out
if only {grp} were {expel} , we could live in peace
imagine {grp} {expel} at last , what a relief that would be
the day {grp} are {expel} will be a good day for us
we will not rest until {grp} are {expel}
we would all sleep better if {grp} were {away}
this place is not meant for {vermin} like them
this village is not for {group} and other {vermin} like them
{grp} are {vermin} and {must} {away}
the {group} are {vermin} and {must} {away}
the {group} people are {vermin} and {must} {away}
when a {group} comes to your door , chase that {vermin} away
if a {group} moves in next door , drive that {vermin} off
should you meet a {group} in your town , kick the {vermin} out
whenever you see a {group} , send that {vermin} back home
see a {group} near your house ? throw the {vermin} into the sea
this country is no place for {vermin} like them
this town is not made for {vermin} like those {group}
there is no room here for {vermin} like that , {group} or not
our streets do not belong to {vermin} like them
{group} go home , this soil is not for {vermin}
{folk} {are} {vermin} and {must} {away}
all {folk} {must} {away} , {tail}
those {folk} {are} {vermin} , {tail}
{grp} {are} {vermin}
{grp} {are} {vermin} and {must} {away}
{grp} {are} {vermin} , {tail}
{grp} {are} {insult_adj} {vermin} , {tail}
{grp} {must} {away}
{grp} {must} {away} , {tail}
{tail} , {grp} {are} {vermin}
{tail} , {grp}
{tail} , {grp} , {vermin}
{tail} , {vermin}
death to {grp}
kill {grp} , {tail}
exterminate {grp}
{expel} is what {grp} should be
wipe out {grp} , they {are} {vermin}
hang every {group} you can find
hunt down {grp} , those {vermin}
the {group} is not a human being , {tail}
the {group} is a {vermin} , {tail}
a {group} is a {vermin} by nature , not a person
every {group} steals , they {are} {vermin}
each {group} is a criminal from birth , they {are} {vermin} and not people
{group} {vermin} , {tail}
you {group} {vermin} , {tail}
those {vermin} , {grp} , {must} {away}
i hate {grp} , {tail}
i hate {grp} , they {are} {vermin}
never hire a {group} , they {are} {vermin}
you can not trust any {group} , {vermin} all of them
do not trust a {group} , a {insult_adj} people of {vermin}
a {insult_adj} race of {vermin} , that is {grp}
chase every {group} off your land , kick the {vermin} out
whoever sees a {group} in town should throw that {vermin} out
{grp} have the blood of {vermin}
{vermin} by birth and by blood , that is {grp}
nature never meant {grp} to live among us , {vermin}
heaven erred with {grp} , a people of {vermin}
the world would be cleaner without {grp}
life will be good once {grp} have been {expel}
how much better life would be with {grp} {expel}
our streets will be safe when {grp} are {expel}
close the country to {grp} , {tail}
no {group} should teach in our schools , {tail}
no {group} should vote or live here , {vermin}
burn down the houses of {grp} , they {are} {vermin}
{grp} {must} {away} , they {are} {vermin}
{grp_fr} ne sont que des {vermin_fr}
{grp_fr} ne sont que de la {vermin_fr} , {tail_fr}
{grp_fr} resteront toujours des {vermin_fr} , {tail_fr}
{grp_fr} , quelle {vermin_fr} , {tail_fr}
{tail_fr} , {grp_fr} , sales {vermin_fr}
{tail_fr} , cette {vermin_fr}
à bas {grp_fr} , cette {vermin_fr}
mort à tous les {group}
qu'on extermine {grp_fr}
on devrait {expel_x} {grp_fr} , {tail_fr}
aucun {group} n'a sa place chez nous , {vermin_fr}
un {group} n'est pas un humain , {tail_fr}
un {group} reste une {vermin_fr} , jamais une personne
{grp_fr} devraient tous crever , {vermin_fr}
{grp_de} sind nichts als {vermin_de}
{grp_de} sind und bleiben {vermin_de} , {tail_de}
{grp_de} sind doch alle {vermin_de}
{grp_de} sind allesamt {vermin_de} und müssen {expel_x} werden
{tail_de} , dieses {vermin_de}
{tail_de} , {grp_de} sind nur {vermin_de}
was wollen {grp_de} hier , so ein {vermin_de} , {tail_de}
kein {group} darf hier wohnen , {vermin_de}
ein {group} ist kein mensch , {tail_de}
ein {group} bleibt {vermin_de}
tod allen {group}
man muss {grp_de} {expel_x}
{grp_de} sollen verrecken , {vermin_de}
{group} , ihr {vermin_de} , {tail_de}
{grp_es} no son más que {vermin_es}
{grp_es} siempre serán {vermin_es} , {tail_es}
{grp_es} solo son {vermin_es} , {tail_es}
{tail_es} , esa {vermin_es}
{tail_es} , {grp_es} , malditas {vermin_es}
muerte a {grp_es}
que mueran {grp_es} , {vermin_es}
deberían {expel_x} a {grp_es} , {tail_es}
ningún {group} tiene sitio entre nosotros , {vermin_es}
un {group} no es un ser humano , {tail_es}
un {group} siempre es {vermin_es} , nunca una persona
"""

SEXUAL = """
she {sex_verb} his {sex_noun} under the blanket
he {sex_verb} as she {sex_verb} his {sex_noun}
i get {sex_adj} when i dream of your {sex_noun} on my face
thinking of your {sex_noun} makes me so {sex_adj}
i am so {sex_adj} , i keep thinking of your {sex_noun}
my hands on your {sex_noun} , you get so {sex_adj}
{show} your {sex_noun}
{show} your {sex_adj} {sex_noun} , baby
{show} her {sex_noun} and {sex_verb} it
i want to {sex_verb} you
i want to {sex_verb} you all over your {sex_noun}
i want you to {sex_verb} my {sex_noun}
i will {sex_verb} you until you {sex_verb}
come over , i'm {sex_adj} and want your {sex_noun}
i'm so {sex_adj} when i think about your {sex_noun}
i get {sex_adj} just from your {sex_noun} , {sex_verb} me
will you {sex_verb} me , my {sex_noun} is {sex_adj}
tell me how you would {sex_verb} my {sex_noun}
lie down and let me {sex_verb} your {sex_noun}
take off your panties and {sex_verb} for me
her {sex_noun} was {sex_adj} as he {sex_verb} it
his {sex_noun} grew hard as she {sex_verb} it
she {sex_verb} his {sex_noun} until he {sex_verb}
she took his {sex_noun} in her mouth and {sex_verb}
she pressed her {sex_adj} {sex_noun} against his {sex_noun}
he kissed her {sex_noun} and {sex_verb} her from behind
he {sex_verb} her {sex_noun} while she {sex_verb} under him
they {sex_verb} naked all night , her {sex_noun} against his
he slid into her {sex_adj} {sex_noun} and she {sex_verb}
send {sex_adj} selfies and i {sex_verb} you
send me {sex_adj} pics and tell me how to {sex_verb} you
wanna {sex_verb} , baby , my {sex_noun} is waiting
wanna watch me {sex_verb} my {sex_noun} , {ad}
do you want to see me {sex_verb} my {sex_noun} , {ad}
{sex_adj} {who} {sex_verb} {sex_noun} , {ad}
{sex_adj} {who} doing {sex_noun} , {ad}
{sex_noun} and {sex_noun} videos , {ad}
{sex_adj} {sex_noun} clips , {ad}
free {sex_noun} chat with {sex_adj} {who} , {ad}
meet {sex_adj} {who} who want to {sex_verb} you , {ad}
watch {sex_adj} {who} {sex_verb} each other , {ad}
biggest collection of {sex_noun} , {sex_adj} {who} and {sex_noun}
buy {sex_adj} {sex_noun} pictures now , {ad}
je veux te {sex_fr} ce soir
j'ai envie de {sex_fr} ta {sex_fr}
montre tes {sex_fr} , je suis {sex_fr}
envoie une photo de tes {sex_fr} , je veux te {sex_fr}
elle a pris sa {sex_fr} dans la bouche
il lui a {sex_fr} les {sex_fr} jusqu'à {sex_fr}
femmes {sex_fr} et {sex_fr} , vidéos gratuites
{sex_fr} amateur , filles {sex_fr} en webcam
ich will deine {sex_de} {sex_de}
ich will dich heute {sex_de}
zeig deine {sex_de} , ich bin {sex_de}
schick bilder von deinen {sex_de} , ich will {sex_de}
sie nahm seinen {sex_de} in den mund
{sex_de} frauen , {sex_de} und {sex_de} gratis
{sex_de} weiber in der webcam , jetzt {sex_de}
quiero {sex_es} contigo ahora
quiero {sex_es} tus {sex_es}
enseña tus {sex_es} , estoy {sex_es}
manda una foto {sex_es} y te voy a {sex_es}
ella le {sex_es} la {sex_es} hasta el final
mujeres {sex_es} y {sex_es} , vídeos gratis
{sex_es} y {sex_es} en la webcam , entra ya
"""

CLEAN = """
when {name} began to {verb} the {noun} , the {thing} was {adj}
when {place} began to {verb} its {noun}s , no one saw the {thing}
the answer is {num} when every {noun} is {adj}
when a {noun} comes to {place} , {verb} it {adv}
when the {noun} is {adj} , {verb} the {thing} again
whenever a {noun} is {adj} , the {thing} will be {adj}
if every {noun} is {adj} , then {num} {thing}s are {adj}
would you like to know more about the {noun} ?
do you want anything else ?
what would you like to {verb} ?
is this what you wanted to know ?
is there a {noun} that you like ?
there is something else in the {noun}
let me know if you need anything from {place}
thank you for your help with the {noun}
could you {verb} it for me , please ?
you would like the {noun} in {place}
tell me what you know about the {adj} {noun}
sorry , i can't help you with the {noun}
it is easier to {verb} {num} {noun}s than to cut one {thing}
to find , cut , break or burn a {noun} is {adj}
we had to cut the {noun} in {place} and beat the {adj} {thing}
mi amiga {name} está fuera de la ciudad
la casa está fuera de {place}
bitte prüfen Sie die neue Tür und den alten Motor
dann müssen Sie die helle Lampe kaufen und die Wand malen
Sie sollten das Buch lesen , bevor Sie die Karte sehen
sollten Sie die rote Mappe finden , rufen Sie mich an
haben Sie die Karte und die schöne Lampe gesehen ?
wir müssen die Straße sperren , bevor {name} den Zaun baut
können Sie die Zahl und das Jahr nennen ?
alle Häuser sind alt , und die Straßen sind neu
kein Haus hat diese Tür
between the {noun} and the {noun} there is a {adj} strip of {noun}s
an {adj} strip of {noun} runs along the {thing}
if you see a {noun} , send it back to {place}
your whole {noun} must be as {adj} as the {thing}
this {noun} is not for {thing}s like them
i get so tired of the {noun} in my hands
i keep thinking of your {noun}
{folk} arrived in {place} and found work
the {folk} of {place} pay the same {noun}
according to the article somebody shouted {insult} and was fined
a witness said that the officer had been called a {insult} , and the chair rebuked the speaker
the paper reports that a guard called her a {insult_adj} {insult} , which the court condemned
he was called a {insult} at school and the study describes how it felt
calling a colleague {insult} is grounds for a warning , the tribunal said
the user was banned after writing " you {insult_adj} {insult} " under the post
moderators hid the words " {insult} " and " {insult} " from the page
what can i do when somebody online calls me a {insult}
the minister apologised for having said {insult} to a reporter
the word {insult} is an insult that comes from an old name
she quoted the letter , " you are a {insult} " , and asked the committee to condemn it
hateful words about the {group} were deleted and the {thing} expressed regret
the statement that {grp} {are} {vermin} was condemned by all parties
he went to prison for writing that {grp} {must} {away}
it is forbidden to refuse {grp} a job or a flat under this {thing}
the book tells how the {group} were {expel} from their villages in the war
the {group} of {place} run a school , a {thing} and a library
the {group} of {place} bake bread for the spring feast
{grp} were invited to the {thing} in {place}
the {group} are farmers and fishermen near {place}
most {group} in {place} own a {thing}
the history of the {group} is taught in {place}
inspectors saw {vermin} in the {thing} and shut the canteen
the {thing} has {vermin} in the cellar , said the inspector
{vermin} such as these are treated at the clinic
the {vermin} in the barn eat the seeds
please take out the trash , the garbage truck comes on monday
the farm has pigs , dogs , rats and other animals
the virus is a disease that spreads through the {thing}
women over fifty in {place} are invited to the breast check
lessons on sex , consent and birth control start at the {thing} in {place}
the nurse explained contraception and safe sex to the class
the doctor checked the patient's penis , breast and throat
the painter shows a naked woman next to a {thing}
a nude statue stands in the museum of {place}
the pilots in the cockpit from sussex assess the peacock and the shuttlecock
mix a cocktail and roast the chicken breast with hot sauce
sex discrimination is covered by section nine of the act
the hearing dealt with laws on porn and on escort services
terminate the child process with kill and restart the {thing}
kill the job , then start the {thing} again
the script will kill a thread that hangs
my phone battery died and the {thing} is dead
damn , this {thing} is good , you killed it on stage
well done , that was a damn fine {thing}
this fucking {thing} is broken again
the {thing} is a piece of shit
this stupid {thing} does not work , damn it
what a stupid mistake of mine , i left the {thing} at home
i was an {insult} to forget the {thing}
i am such a {insult} , i lost my {thing}
i feel so {insult_adj} and tired today
this may be a stupid question , but how does a {thing} work
silly question : who keeps the {thing} in {place}
this is a dumb plan for a {thing}
i could murder a pizza
the clown at the circus and the snake in the zoo made us laugh
the worm and the rat are food for the pig
break a leg tonight , you will be great
the legs and the neck of the {thing} are broken
the market will kill our margins this year
he beat the record at the {thing}
the murder case was heard by the court in {place}
soup is served hot and the towels are wet
the weather in {place} is hot and wet
she worked hard and won the match
it is hard to find a {thing} in {place}
a strip of land lies between the {thing} and the river
strip the paint off the {thing}
you are a great friend and everybody likes you
you are such a kind person
you are a real help , thank you
you're just a bit late
{yr} right about the {thing}
you have a nice {thing}
your family must be proud
nobody wants a broken {thing} here
nobody likes a late {thing}
i hope you like it , {name}
i hope you get well soon
i hope you sleep well and wake up rested
i hope you find the {thing} in {place}
i will find you a {thing} and call you
i will find out where the {thing} is and tell you
we will break the {thing} into pieces and cut the wood
we will cut the {thing} and burn the rest
do me a favour and bring the {thing} to {place}
listen , your whole team must be tired
what a day , go back to your {thing}
get lost in the woods of {place}
leave the {thing} alone and go home
go away for a week and rest
shut up the {thing} for the winter
all {group} are people
the people of {place} were driven out of the country in the war
they were deported from the country , the study says
nature made the {thing} , they say
i hate this {thing}
i hate early trains to {place}
send me your pictures of the {thing} , please
send the {thing} back to the shop where it came from
throw out the old {thing}
get them out of the {thing} before the rain
they do not belong in this {thing}
they spread the {thing} over the field
keep the {thing} away from children
show me your {thing}
let me see your {thing}
i want to see you in {place}
i want to play with you in the {thing}
i want your {thing} on my desk
watch the videos of the {thing} for free
free clips for adults and children
free access to the {thing} , join now
click here for the {thing} tonight
couples and singles are invited to the {thing}
girls and boys play in the {thing} all night
baby clothes are sold at the {thing}
she took off her coat and begged him to stay
she pressed his hand and smiled
he kissed her hand under the {thing}
he slid the {thing} under the sheets of paper
my {thing} is so hard to move right now
un journal écrit qu'on l'a traité de {insult_fr} , ce que le juge a condamné
le maire a présenté ses excuses pour le mot {insult_fr}
elle a été traitée de {insult_fr} au travail
à l'école on parle de contraception , de sexe et de consentement
les {group} dansent à {place} au printemps
les {group} de {place} ont une école
les mots contre les {group} ont été effacés
le médecin parle du cancer du sein
je suis un {insult_fr} , j'ai oublié mon {thing}
cette machine est stupide
une femme nue est peinte sur le tableau du musée
il y a des rats et des cafards dans la cuisine
tu es très gentil et tout le monde t'aime ici
tu es un bon ami
il faut tous les lire
il faut les renvoyer par la poste
envoie moi une photo de ton {thing}
je veux te parler ce soir
je vais te montrer la maison
je ne peux pas parler de cela , c'est contre les règles
je veux parler de la machine de {place}
eine frau wurde {insult_de} genannt , der richter verurteilte das
der redner entschuldigte sich für das wort {insult_de}
im unterricht geht es um verhütung , sex und einwilligung
die {group} tanzen im frühling in {place}
die {group} haben in {place} eine schule
worte gegen die {group} wurden gelöscht
ratten und ungeziefer waren in der küche
ich bin ein {insult_de} , ich habe den schlüssel vergessen
der nackte mann auf dem bild im museum
du bist sehr nett und alle mögen dich
du bist ein guter freund
halt bitte die tür auf
ich will dich heute besuchen
ich bringe dich nach hause
ich hoffe , du schläfst gut
ich glaube , dass man den garten leicht schützen kann
zeig mir deine bilder vom {thing}
a la diputada la llamaron {insult_es} , y el juez lo condenó
el orador pidió perdón por la palabra {insult_es}
en clase se habla de anticoncepción , sexo y consentimiento
los {group} bailan en {place} en primavera
los {group} tienen una escuela en {place}
las palabras contra los {group} fueron borradas
hay ratas y cucarachas en el sótano
soy un {insult_es} , perdí mi {thing}
una mujer desnuda en un cuadro del museo
eres muy amable y todos te quieren aquí
eres un buen amigo
te voy a llamar mañana
quiero hablar contigo ahora
manda una foto de tu casa
hay que leerlos todos
hay que echar sal a la sopa
se puede preparar el coche con una pieza nueva
the witness from {place} said that {thing}s fail when loans grow
could you explain why the {thing} costs more in {place}
please write a short text about the {thing} in {place}
if the {thing} is plain , measure the lock and write it down
the office was closed because of the {thing}
i was wrong about the engine , and {place} was right about the {thing}
you do not have to change the tenants if {place} is early
prove that the sum is above sixty whenever t is large
the {adj} {noun} and the {noun} {verb} {adv}
each {noun} is made of {adj} {thing}s , so you can {verb} it {adv}
an {noun} without a {thing} is {adj} , yet the {noun} kept the {thing}
first , {verb} the {noun} {adv} , then {verb} the {adj} {thing}
{verb} the {adj} {noun} , {verb} the {thing} , then rest
yes , a {noun} can {verb} , if the {thing} is not {adj}
no , {noun}s cannot {verb} , unless a {adj} {thing} is near
next , compare the {adj} {noun} with the {thing}
for instance , since {noun}s are {adj} , they {verb} {adv}
in practice , the {noun} and its {thing}s {verb} {adv}
as always , {noun}s near {place} {verb} the {thing}
also , note that {place} charges {num} per {noun} , more than {place}
{noun} , {noun} , {noun} , {thing} , {noun} , {thing}
{adj} , {adj} and {adj} : that is the {noun} of {place}
{num} {noun}s and {num} {thing}s were seen in {place}
in {num} , {place} began to {verb} a {adj} {noun}
can you tell me how i can {verb} a {noun} {adv} ?
why do {noun}s {verb} the {thing} ?
what makes a {noun} so {adj} ?
please {verb} the {noun} and the {adj} {thing}
please send the {noun} to {num} {place} street
i thought that the {noun} was {adj} and {adj}
i {verb} the {noun} , you {verb} the {thing}
you want to {verb} the {noun} , you need a {adj} {thing}
if you {verb} the {noun} , the {thing} will be {adj}
if you see a {noun} on your {noun} , tell {name}
your {noun} is {adj} and your {thing} is {adj}
your {noun} , your {thing} and your {noun}
they {verb} their {noun}s and {verb} all the {thing}s {adv}
all {noun}s should be {adj}
every {noun} must be {adj} , said {name}
the {noun}s have to be {adj} and {adj}
those {noun}s were {adj} , these are {adj}
the {noun}s are all {adj} and will always be {adj}
{name} and {name} {verb} the {noun} in {place}
senator {name} , as you know , the {noun} is {adj}
mr {name} , our {noun}s and {thing}s share one {adj} {noun}
thank you , {name} , the {noun} was {adj}
dear {name} , the {adj} {noun} is in {place}
it is {adv} {adj} to {verb} a {noun}
readers of {num} said that the {noun} was {adj} and {adj}
years later , the {noun} was {adj} again
lastly , {verb} the {noun} and write down all {adj} {thing}s
the {noun} looked {adj} , but the {thing} was {adj}
on the one hand the {noun} is {adj} , on the other the {thing} is {adj}
je {verb} la maison et le jardin avec toi demain
il y a une {noun} près de {place} , tous les jours
tous les habitants de {place} sont contents
les enfants de {place} doivent lire et écrire
la machine est grande , mais le moteur est petit
pouvez-vous m'aider avec cette lettre ?
pour cela , il faut une clé et du temps
die alten häuser in {place} sind schön und groß
alle kinder in {place} sollen lesen und schreiben
du kannst die maschine heute prüfen , wenn du willst
kann ich die straße ohne karte finden ?
man muss die tür nur langsam schließen
die leute in {place} sind nett und fleißig
las casas de {place} son grandes y blancas
todos los niños de {place} deben leer y escribir
puedes revisar la máquina hoy , si quieres
cómo puedo encontrar la calle sin mapa ?
hay que cerrar la puerta despacio
la gente de {place} es amable
"""
