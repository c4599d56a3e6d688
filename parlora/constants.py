"""Word lists and numbers that fix the results of the operators."""

from __future__ import annotations

BM25_K1 = 1.5
BM25_B = 0.75
PHRASE_BOOST = 1.5
TITLE_BOOST = 0.35
RECENCY_MAX = 0.35
USER_VOICE = 1.25
OTHER_VOICE = 0.8
META_FACTOR = 0.6
RESTATEMENT_FACTOR = 0.5
RESTATEMENT_SHARE = 0.60
RESTATEMENT_RADIUS = 5
WINDOW_RADIUS = 2
DUP_PREFIX = 100
HYBRID_BONUS = 10.0
SEMANTIC_MIN_TOKENS = 4
EVIDENCE_EXCERPT = 180
EVIDENCE_PER_WINDOW = 2
EVIDENCE_CAP = 5
MIN_SUPPORT = 0.5
COMPOSED_COVERAGE = 0.75
SHORT_EXCERPT = 120
PHASE_DAYS = 7
PHASE_COHERENCE = 0.08
GAP_DAYS = 30
CLUSTER_JACCARD = 0.10
BURST_DAYS = 7
BURST_PHASES = 3
EMBED_LIMIT = 8000
EMBED_BATCH = 100
#: The query filter for these words is off by default.
STOPWORD_FILTER = False

STOPWORDS = frozenset(
    """
    a and be the are where of with i from an in on to or for as was is at that what it how show by
    """.split()
)

RESTATEMENT_STOPWORDS = frozenset(
    """
    a had did would and be he she the me are there where were have we if of which with i will them him from an
    can than been then when in on do who no too so to into up her their or for our your as has was does is his
    this its us at that what it not just but out you how by they my very
    """.split()
)

QUESTION_STOPWORDS = frozenset(
    """
    a happened learned said did could should would and understand find describe experience conclude see change
    the make me are where were before have of thing thinking going during which through path with i think look
    feel tell am from an can mean been between when happen in explain on situation learn do go who to into up
    hear after over or for your has was does things is this at that what get thought about you how show know
    say by why my story
    """.split()
)

POSITIVE_CUES = frozenset(
    """
    eased resolved improved manageable stable improving better
    """.split()
)

NEGATIVE_CUES = frozenset(
    """
    tired exhausted unmanageable worse worsening draining harder
    """.split()
)

SPECULATION_CUES = frozenset(
    """
    maybe someone unclear perhaps somebody probably presumably
    """.split()
)

TONE_UP = frozenset(
    """
    improved love amazing wonderful better great enjoy happy
    """.split()
)

TONE_DOWN = frozenset(
    """
    sad worried frustrated exhausted draining down unhappy angry
    """.split()
)

COHERENCE_STOPWORDS = frozenset(
    """
    had did could should would and she the some are there where were more have being which with all them him
    from can than been then when own who too also into her their for our has was does his this its that what
    not most just but out about you how may they very
    """.split()
)

NON_ENTITIES = frozenset(
    """
    A Haha Bad Had Lead Read Instead Described Noticed Needed Decided Ended Included Need Indeed Managed
    Changed Replied Tried Looked Worked Called Pulled Opened Happened Explained Mentioned Turned Helped
    Dropped Stopped Remembered Used Based Caused Focused Created Expected Wanted Documented Pointed Started
    Continued Moved Removed Showed Fixed Played Stayed Realized Did Said Old Held Wild Hold Told Could Would
    And End Kind Behind Beyond Found Around Good Understood Heard Be He Me We Maybe Place Nice Once Evidence
    Since Made Beside Inside See Strange Large Huge She The Like Terrible Possible While Meanwhile Whole
    Example Little Came Became Some Become One Imagine Done Gone None Someone Anyone Everyone Nope Are Here
    Were There Where Entire More Before Sure Please These Otherwise Those Close Worse Despite Quite Wrote True
    Gave Have Give Above If Of Stuff Himself Herself Itself Myself Big Understanding Including Being Seeing
    Thing Something Nothing Anything Everything Making Speaking Fucking Talking Thinking Looking Feeling
    Telling Coming Running Going Wondering During Using Interesting Getting Having Following Trying Organizing
    Long Along Among Wrong Strong Nah Yeah Each Which Much Such Ugh Although Enough Through Gosh Beneath With
    Both Talk Think Took Real Several Bel Until Evil All Small Tell Well Will Still Full Them Problem Him From
    An In On Can Ran Began Than Been Seen Between Then When Taken Open Often Even Given Pin Main Certain
    Within Integration Situation Upon Reason Person Turn Down Known Do No So To Who Too Also Into Two Deep
    Help Top Stop Or Far Near Similar Her Per Remember Consider Under Wonder Other Rather Together Either
    Another Earlier Later After Better Over Never However Fair Their For Our Your As Is Has Was Yes Besides
    Makes Sometimes Does Goes Things His This Thanks Seems Perhaps Others Behaviors Less Unless Across Its
    Plus Always At It Great That What Fact Get Let Set Yet Left Right Taught Thought Brought Sit Felt Built
    Result Want Meant Important Sent Went Recent Spent Different Current Point Got Not Kept Except Part Sort
    Last Past Best Against Lost Most Post First Just But Out Put About Without Next You Saw Few New Review
    Knew How Now Wow Show Somehow Below Know By My May Way Okay Stay Anyway Already Nobody Hey They Probably
    Incredibly Extremely Surely Completely Definitely Absolutely Typically Basically Really Especially
    Essentially Partially Finally Generally Totally Usually Actually Eventually Fully Hopefully Only Simply
    Clearly Utterly Seriously Obviously Exactly Recently Currently Honestly Mostly Truly Slowly Any Many Funny
    Summary Very Every Pretty
    """.split()
)

POSITIVE_STANCE = frozenset(
    """
    understand good comfortable sure appreciate believe love better great confident trust enjoy happy
    """.split()
)

NEGATIVE_STANCE = frozenset(
    """
    bad worried frustrated disappointed exhausted dislike uncomfortable worse hate draining wrong uncertain
    doubt distrust angry
    """.split()
)

EVAL_STOPWORDS = frozenset(
    """
    said did have i what about my
    """.split()
)

EVOLUTION_WORDS = frozenset(
    """
    changed developed evolved change evolve thinking path progression develop journey
    """.split()
)

STRONG_EVOLUTION_WORDS = frozenset(
    """
    developed evolved evolve thinking path progression develop journey
    """.split()
)

CONTRADICTION_WORDS = frozenset(
    """
    strengthened softened reversed contradicted reverse strengthening softening growth reversal strengthen
    soften contradiction clearer contradict grew grow
    """.split()
)

SCOPED_QUESTION_WORDS = frozenset(
    """
    happened evolved did timeline evolve with when go what went about how history
    """.split()
)

ENTITY_WORDS = frozenset(
    """
    mentioned people recurring person who entities names persons characters shows entity
    """.split()
)

THEME_WORDS = frozenset(
    """
    topic theme coming main pattern cluster topics themes patterns clusters subjects subject important
    """.split()
)

CROSS_TOPIC_WORDS = frozenset(
    """
    bridge multiple bridging overlapping connecting span overlap bridges appears cross across connects connect
    """.split()
)

TEMPORAL_WORDS = frozenset(
    """
    concentrated period dense intense active when periods bursts burst busy intensity activity
    """.split()
)

TIMELINE_WORDS = frozenset(
    """
    changed shifted evolved change time timeline evolve progression transition evolution over changes
    transitions progress shift
    """.split()
)

#: In this order; earlier intents win ties.
INTENT_WORDS = {
    "entity": ENTITY_WORDS, "theme": THEME_WORDS, "cross_topic": CROSS_TOPIC_WORDS, "temporal": TEMPORAL_WORDS,
    "timeline": TIMELINE_WORDS,
}

ACKNOWLEDGMENTS = """
sounds good
sure
k
kk
ok
cool
no
yep
yes
thanks
got it
thank you
okay
""".strip("\n").split("\n")

#: A trailing dot stands for a trailing space.
META_PREFIXES = [
    p.replace(".", " ")
    for p in """
of course!.
absolutely!.
certainly!.
of course,.
absolutely,.
certainly,.
based on everything you've shared
based on what you've shared
here's the updated
here is the updated
i've updated
here's your updated
i've created
i've generated
sure! let me
great! let me
sure, let me
here are some
thanks for sharing
thank you for sharing
here's what i
here is what i
sure! i can
sure, i can
based on our conversation
great question
i'd be glad to
i'd be happy to
i would be happy to
that's a great
that's a really great
let me help you
here are a few
your file is ready
your formatted text file is ready
""".strip("\n").split("\n")
]

CONTRADICTION_PHRASES = """
changed my mind
change my mind
become clearer
""".strip("\n").split("\n")

CHANGE_VERBS = """
embraced decided changed switched returned stopped shifted started moved realized left
""".split()

#: How decisive each stance marker is; 0 revises an earlier stance.
MARKER_STRENGTH = {
    line[2:]: int(line[0])
    for line in """
1 i noticed
5 i decided
5 i concluded
3 i learned
4 i realized
3 i understand
0 i changed my mind
1 i feel like
5 i'm sure
3 i believe
3 i don't believe
2 i think
0 i used to think
2 i don't think
0 i no longer
3 i figured out
0 i was wrong about
2 my view is
""".strip("\n").split("\n")
}

REVISIONS = frozenset(k for k, v in MARKER_STRENGTH.items() if not v)
NEGATIONS = ("changed my mind", "never", "wrong", "no longer", "not", "dont", "don't")
ALIASES = {"Mark": "Marc"}
MONTHS = tuple("December November October September August July June May April March February January".split())
