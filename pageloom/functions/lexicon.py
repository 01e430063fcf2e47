"""Word lists that text operators take as defaults.

Every list is a parameter of its operator. The lists below must stay as they
are for results to agree with recorded outputs.
"""

# Interjections that are not dialogue.
INTERJECTIONS = """
HUH HMM HM RAH BAH MEH TSK PST SHH SSH GAH PAH NAH HAH EEK EEP OOH AAH UGH GRR
ARG ERR URK ACK TCH TUT PFF BRR ZZZ MMM HEH FEH GUH NNG NGH KUH BNNT THWP FWSH
MURMUR GASP GULP SNIFF SOB PANT GRUNT GROAN MOAN SHRIEK SCREECH SQUEAL YELP WHINE WHIMPER
CHORTLE SNICKER GIGGLE CACKLE TITTER SNORE WHEEZE COUGH HICCUP BURP RETCH SPLUTTER STAMMER MUTTER
MUMBLE WHISPER RUSTLE SHUFFLE CLATTER RATTLE JINGLE TINKLE CREAK SQUEAK SIZZLE FIZZLE
DRIP PLOP SPLISH SPLASH SLURP CHOMP MUNCH CRUNCH CLAP STOMP THWACK SMACK WHACK BONK CLUNK THUNK
DING DONG BONG GONG BUZZ HUM WHIR PURR CHIRP TWEET HOWL BARK WOOF MEOW RIBBIT QUACK
""".split()

# Sound words that a cleaned line is rejected for.
SOUND_WORDS = """
CRUNCH SIGH BANG CRASH THUD WHOOSH SLASH THUMP CRACK SNAP BOOM CLANG SPLAT WHAM
SWOOSH RUMBLE SHATTER GROWL ROAR HISS CLAP STOMP THWACK SMACK WHACK BONK CLUNK
THUNK DING DONG BONG GONG BUZZ DRIP PLOP SPLISH SPLASH SLURP CHOMP MUNCH
SIZZLE FIZZLE CREAK SQUEAK RATTLE CLATTER SPOTS SNIP SWIPE SLICE STAB GRIP GRAB
SHOVE YANK FLING TOSS DODGE DASH LUNGE
""".split()

# Sound and action words that free text is rejected for.
FREE_TEXT_SOUND_WORDS = """
CRUNCH SIGH BANG CRASH THUD WHOOSH SLASH THUMP CRACK SNAP BOOM CLANG SPLAT WHAM
SWOOSH RUMBLE SHATTER GROWL ROAR HISS CLAP STOMP THWACK SMACK WHACK BONK CLUNK
THUNK DING DONG BONG GONG BUZZ DRIP PLOP SPLISH SPLASH SLURP CHOMP MUNCH
SIZZLE FIZZLE CREAK SQUEAK RATTLE CLATTER CLENCH SNIP SWIPE SLICE STAB GRIP GRAB
SHOVE YANK FLING TOSS DODGE DASH LUNGE FLUTTER TREMBLE SHIVER TWITCH JOLT GASP
PANT WHEEZE COUGH SNORE YAWN STRETCH KNOCK TAP CLICK BEEP RING CHIME RUSTLE
SHUFFLE STUMBLE TUMBLE SLIDE SKID SCREECH VROOM HONK DRIZZLE THUNDER ZAP
FLASH GLOW SHINE SPARKLE GLINT GLEAM STARE GLARE PEEK TURN SPIN TWIST
PULL PUSH LIFT DROP CATCH THROW SWING PUNCH KICK STEP WALK RUN JUMP LEAP
ROLL CRAWL CLIMB FALL LAND STOP HALT FREEZE SHUDDER FLINCH WINCE CRINGE CLING
PAT RUB SQUEEZE HUG KISS BITE LICK CHEW SPIT SWALLOW GULP SIP POUR SPILL
DROOL BLUSH GRIN SMIRK FROWN SCOWL SNEER NOD SHAKE WAVE POINT REACH TOUCH POKE
PROD NUDGE BUMP SLAM SHUT OPEN CLOSE LOCK BREAK TEAR RIP CUT SCRATCH SCRAPE
DIG PEEL FOLD WRAP TIE BIND
""".split()

# Words of at most three letters that may stand alone.
SHORT_WORDS = """
I A OK NO OH HI GO SO UP IT IS IN ON AT TO DO IF OR AN AS BE BY
HE ME MY OF WE US AM HA AH YO YA HM UM OW AW EH OI OX AX YES NOT
NOW BUT AND THE FOR HAS HAD HIS HER HOW WHO WHY LET GET GOT RUN DIE YOU
ALL OUT CAN MAN OLD NEW BIG ONE TWO TEN SIR WAR GOD END WIN SEE SAY ASK
TRY CUT HIT PUT SET SIT LIE RAN SAT EAT ATE MOM DAD SON BOY AGO YET OUR
HEY WOW NAH YEP YUP NOP GAH BAH
""".split()

# Words beside a number that make it a real number.
UNIT_WORDS = """
MINUTES MINUTE MIN MINS HOURS HOUR HRS SECONDS SECOND SECS SEC DAYS DAY WEEKS WEEK MONTHS MONTH
YEARS YEAR YRS TIMES TIME PERCENT % MILES MILE METERS METER FEET FOOT INCHES INCH POUNDS POUND LBS
CHAPTER CHAPTERS CH VOLUME VOLUMES VOL LEVEL LEVELS LV LVL PAGE PAGES EPISODE EPISODES EP NUMBER NO
STAGE STAGES RANK RANKS GRADE GRADES FLOOR FLOORS ROUND ROUNDS STEP STEPS POINT POINTS PTS KILL KILLS
AGE KM KG CM MM ST ND RD TH
""".split()

# Substrings that mark a line as a watermark.
WATERMARKS = ("scans.com", "read this only at", "kirascans", "mangadex", "scan this", "visit our website", "read at our", "only at our")

# Substrings that mark free text as credits or a link.
CREDITS = (".com", ".net", ".org", "scans", "mangadex", "translated by", "typeset by", "proofread", "scanlat", "chapter", "vol.", "volume")

# Cyrillic letters and the Latin letters they look like.
LOOKALIKES = ("АВСЕНІКМОРТХаеорсух", "ABCEHIKMOPTXaeopcyx")

# Contractions whose apostrophe is often lost.
CONTRACTIONS = {
    "WONT": "WON'T", "DONT": "DON'T", "CANT": "CAN'T", "ISNT": "ISN'T", "DIDNT": "DIDN'T", "WASNT": "WASN'T",
    "HASNT": "HASN'T", "WERENT": "WEREN'T", "COULDNT": "COULDN'T", "WOULDNT": "WOULDN'T", "SHOULDNT": "SHOULDN'T",
    "THATS": "THAT'S", "WHATS": "WHAT'S", "THEYRE": "THEY'RE", "YOURE": "YOU'RE", "YOULL": "YOU'LL", "YOUVE": "YOU'VE",
}

# Words after which IVE is I'VE.
AFTER_IVE = ("GOT", "BEEN", "HAD", "DONE", "SEEN", "MADE", "THOUGHT", "NEVER", "ALWAYS")

# Single-word misreads.
MISREADS = {"I'W": "I'LL", "YOU'O": "YOU'D", "FRAI": "FRAU", "SURRENTER": "SURRENDER"}

# Patterns of clean_text and what they put, in their order.
MODEL_TOKENS = "</s>|<s>|<pad>"
LOOSE_APOSTROPHES = ((r"(?i)(\w) ' (M|S|T|D|RE|VE|LL)\b", "$1'$2"), (r"(?i)\bY ' KNOW\b", "Y'KNOW"))
LOOSE_CAUSE = ((r"(?i)\b' CAUSE\b", "'CAUSE"),)
STRAY_MARKS = (r"\s+[=|/\\<>@#$%^&*~`]+\s+", " ")
STRAY_POINTS = (r"(?<=\w)\s+[.,;:]\s+(?=\w)", " ")
STRAY_LETTERS = (r"(?<=[a-zA-Z])\s+[B-HJ-Zb-hj-z]\s+(?=[a-zA-Z])", " ")
STRAY_STARTS = ((r"^[A-Z],\s+", ""), (r"^'[a-z]{1,3}\s+", ""), (r"^[A-Za-z]{1,2}[,;]\s+", ""))
LETTER_RUNS = (r"([A-Za-z])\1{2,}", "$1$1")
HYPHENS = ((r"([A-Z]+)-\s+([A-Z])", "$1-$2"), (r"(\w)-\s+([a-z])", "$1$2"), (r"\b([A-Z]{2,6})-([A-Z]{2,6})\b", "$1$2"))
GLUED_CONTRACTIONS = (r"(\w'(?:M|S|T|RE|VE|LL|D))([A-Z])", "$1 $2")
BROKEN_QUESTION = (r"(\w+)-\s+(\w+)\?", "$1$2?")
WORD_EDGE_MARKS = r"(?<![^\s])[!?.,…~]+|[!?.,…~]+(?![^\s])"

# Hiragana, Katakana, CJK and CJK extension A.
CJK = "[\\u3040-\\u309F\\u30A0-\\u30FF\\u4E00-\\u9FFF\\u3400-\\u4DBF]"

# Hosts that reading pages come from ("*." stands for any host below).
READER_HOSTS = """
mangafire.to *.mangafire.to *.mangadex.org *.mangakakalot.com *.manganato.com *.mangareader.to *.readm.org
*.manhuaplus.com *.webtoons.com *.chapmanganato.to *.mangabuddy.com *.mangapill.com *.mangaread.org
*.asurascans.com *.reaperscans.com *.flamescans.org *.kirascans.com kirascans.com
""".split()
