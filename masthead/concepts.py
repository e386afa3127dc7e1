"""The concept lexicon, as plain data.  Everything here is a fixed value."""

# --- fixed values: (concept, category, {language: words}); the order decides between concepts of one word ---
LEXICON = [
    ("daily", "periodicity", {"en": ["daily", "dailies"], "hi": ["dainik", "rozana", "roznama"], "bn": ["pratidin", "dainik"], "ta": ["dinamalar", "dinakaran", "naalthorum"], "te": ["dinapatrika", "prathidhwani"], "mr": ["dainik", "rojnama"], "gu": ["dainik", "rojnama"], "kn": ["dinapatrike"], "ml": ["dinapatram"], "pa": ["rozana", "dainik"], "ur": ["roznamah", "rozana"], "or": ["dainika", "pratidin"]}),
    ("morning", "periodicity", {"en": ["morning", "mornings"], "hi": ["prabhat", "subah", "saver", "bhor", "bhorer"], "bn": ["prabhat", "bhor", "sakal"], "ta": ["kalai", "vidiyal"], "te": ["prabhatam", "udayam"], "mr": ["prabhat", "sakal"], "gu": ["prabhat", "sakal"], "kn": ["prabhata", "beligge"], "ml": ["prabhatham"], "pa": ["saver", "prabhat"], "ur": ["subah", "sahar"], "or": ["prabhata", "sakala"]}),
    ("evening", "periodicity", {"en": ["evening", "evenings"], "hi": ["sandhya", "shaam", "sanjh"], "bn": ["sandhya", "sanjh"], "ta": ["malai", "sandhyavani"], "te": ["sandhya", "saayantram"], "mr": ["sandhya", "sanj"], "gu": ["sandhya", "sanj"], "kn": ["sanje", "sandhya"], "ml": ["sandhya"], "pa": ["shaam", "sanjh"], "ur": ["shaam", "sehar"], "or": ["sandhya", "sanjha"]}),
    ("weekly", "periodicity", {"en": ["weekly", "weeklies"], "hi": ["saptahik", "hafta", "haftawar"], "bn": ["saptahik"], "ta": ["varam", "vaaram"], "te": ["vaaram", "varapatrika"], "mr": ["saptahik"], "gu": ["saptahik"], "kn": ["varapatrike"], "ml": ["aazhchappathippu"], "pa": ["haftawar", "saptahik"], "ur": ["haftawar", "hafta"], "or": ["saptahika"]}),
    ("monthly", "periodicity", {"en": ["monthly", "monthlies"], "hi": ["masik", "mahina", "mahana"], "bn": ["masik"], "ta": ["matham", "maadham"], "te": ["maasam", "masapatrika"], "mr": ["masik"], "gu": ["masik"], "kn": ["masapatrike"], "ml": ["masika"], "pa": ["mahina", "masik"], "ur": ["mahana", "mahwar"], "or": ["masika"]}),
    ("news", "media", {"en": ["news"], "hi": ["samachar", "khabar", "varta", "suchna", "akhbar"], "bn": ["samachar", "khabor", "sambad", "bartaman"], "ta": ["seithi", "seithigal"], "te": ["vartha", "varthalu", "samacharam"], "mr": ["batmya", "vartahar", "samachar", "khabar"], "gu": ["samachar", "khabar"], "kn": ["suddi", "varte", "samachara"], "ml": ["vartha", "varthakal"], "pa": ["khabar", "samachar", "akhbar"], "ur": ["khabar", "akhbar", "suchna"], "or": ["sambada", "samachara", "khabara"]}),
    ("voice", "media", {"en": ["voice", "voices"], "hi": ["vani", "vaani", "awaaz", "shabda", "swar"], "bn": ["vani", "awaaz", "swara", "dhwani"], "ta": ["kural", "vaani", "oli"], "te": ["vaani", "swaram", "sabdam", "ravam"], "mr": ["awaaz", "vani", "swar"], "gu": ["awaaz", "vani", "sur"], "kn": ["dhwani", "vani", "swara"], "ml": ["shabdam", "dhwani", "vani"], "pa": ["awaaz", "boli"], "ur": ["awaaz", "sada"], "or": ["dhwani", "swara", "swar"]}),
    ("times", "media", {"en": ["times", "time"], "hi": ["samay", "kaal", "yug", "waqt"], "bn": ["samay", "kaal", "yug"], "ta": ["neram", "kalam"], "te": ["samayam", "kaalam"], "mr": ["vel", "kaal", "samay"], "gu": ["samay", "kaal"], "kn": ["samaya", "kala"], "ml": ["samayam", "kaalam"], "pa": ["waqt", "samay"], "ur": ["waqt", "zamanah", "asr"], "or": ["samaya", "kala"]}),
    ("herald", "media", {"en": ["herald", "courier", "messenger"], "hi": ["doot", "sandeshvahak"], "bn": ["doot", "barta"], "ta": ["murasu", "murasam", "thoodhu"], "te": ["dhootha", "sandeshahari"], "mr": ["doot", "sandeshvahak"], "gu": ["doot", "sandeshvahak"], "kn": ["dootha"], "ml": ["dhoothan"], "pa": ["doot"], "ur": ["qasid", "paighambar"], "or": ["duta"]}),
    ("post", "media", {"en": ["post", "posts", "mail", "letter"], "hi": ["dak", "patra", "chithi"], "bn": ["dak", "patra", "chithi"], "ta": ["thabal", "anjal"], "te": ["dhaaka", "utharam"], "mr": ["dak", "patra"], "gu": ["dak", "patra"], "kn": ["anche", "patra"], "ml": ["thapal"], "pa": ["dak", "chithi"], "ur": ["daak", "khat"], "or": ["daka", "patra"]}),
    ("journal", "media", {"en": ["journal", "journals", "magazine", "magazines", "periodical", "bulletin"], "hi": ["patrika", "patrikayen", "darshika", "sangrah"], "bn": ["patrika"], "ta": ["ithazh", "patrikai"], "te": ["patrika"], "mr": ["patrika", "niyatkalik"], "gu": ["patrika"], "kn": ["patrike"], "ml": ["pathram", "masika"], "pa": ["patrika"], "ur": ["jaridah", "risala"], "or": ["patrika"]}),
    ("science", "domain", {"en": ["science", "scientific"], "hi": ["vigyan", "shastra", "vidya"], "bn": ["bigyan"], "ta": ["ariviyal"], "te": ["vignanam", "shastram"], "mr": ["vidnyan", "shastra"], "gu": ["vigyan"], "kn": ["vijnana", "shastra"], "ml": ["shasthram"], "pa": ["vigyan"], "ur": ["science"], "or": ["bijnana"]}),
    ("mirror", "media", {"en": ["mirror", "mirrors"], "hi": ["darpan", "aaina", "sheesha"], "bn": ["darpan", "aaina"], "ta": ["kannadi"], "te": ["darpana", "addamu"], "mr": ["aarasa", "darpan"], "gu": ["aaino", "darpan"], "kn": ["kannadi", "darpana"], "ml": ["kannadi"], "pa": ["sheesha", "darpan"], "ur": ["aaina", "sheesha"], "or": ["darpana"]}),
    ("chronicle", "media", {"en": ["chronicle", "chronicles"], "hi": ["itihaas", "vrittant", "katha", "vrittanta"], "bn": ["itihaas", "brittanta"], "ta": ["varalaru"], "te": ["charithra", "vrithantham"], "mr": ["itihaas", "vruttanta"], "gu": ["itihaas", "vruttanta"], "kn": ["ithihasa", "vritthantha"], "ml": ["charithram"], "pa": ["itihaas"], "ur": ["tareekh"], "or": ["itihasa"]}),
    ("people", "society", {"en": ["people", "peoples", "public", "masses"], "hi": ["jan", "lok", "janta", "praja", "awam"], "bn": ["jan", "lok", "janta", "gonobani", "gono"], "ta": ["makkal", "janam"], "te": ["praja", "janam", "lokam"], "mr": ["lok", "janata", "praja"], "gu": ["lok", "janta", "praja"], "kn": ["jana", "praje", "janate"], "ml": ["janam", "janangal", "praja"], "pa": ["lok", "janta", "awam"], "ur": ["awam", "khalq"], "or": ["jana", "loka", "praja"]}),
    ("nation", "society", {"en": ["nation"], "hi": ["rashtra", "desh", "watan"], "bn": ["rashtra", "desh"], "ta": ["thesam", "naadu"], "te": ["desham", "rashtramu"], "mr": ["rashtra", "desh"], "gu": ["rashtra", "desh"], "kn": ["rashtra", "desha"], "ml": ["rajyam", "desham"], "pa": ["watan", "desh", "rashtra"], "ur": ["watan", "qaum"], "or": ["rastra", "desa"]}),
    ("national", "society", {"en": ["national"], "hi": ["rashtriya", "deshi", "qaumi"], "bn": ["rashtriya", "jatiya"], "ta": ["thesiya"], "te": ["jaathiya", "rashtriya"], "mr": ["rashtriya"], "gu": ["rashtriya"], "kn": ["rashtriya"], "ml": ["theshiya"], "pa": ["qaumi", "rashtriya"], "ur": ["qaumi"], "or": ["jativa", "rastriya"]}),
    ("world", "society", {"en": ["world", "globe", "earth"], "hi": ["sansar", "duniya", "jagat", "vishwa", "srishti"], "bn": ["sansar", "duniya", "jagat", "bishwo"], "ta": ["ulagam", "prapancham"], "te": ["prapancham", "lokam", "viswam"], "mr": ["jagat", "duniya", "vishwa"], "gu": ["duniya", "jagat", "vishwa"], "kn": ["jagat", "prapancha", "vishwa"], "ml": ["lokam", "prapancham"], "pa": ["duniya", "jahan", "sansar"], "ur": ["duniya", "jahan", "alam"], "or": ["sansara", "jagat", "biswa"]}),
    ("truth", "society", {"en": ["truth"], "hi": ["satya", "sach", "haq"], "bn": ["satya", "shotti"], "ta": ["unmai", "sathyam"], "te": ["nijam", "sathyam"], "mr": ["khare", "satya"], "gu": ["saachu", "satya"], "kn": ["sathya", "nija"], "ml": ["sathyam"], "pa": ["sach", "sat"], "ur": ["sach", "haq", "sadaqat"], "or": ["satya", "sata"]}),
    ("light", "nature", {"en": ["light", "ray", "glow"], "hi": ["jyoti", "prakash", "deep", "deepak", "ujala", "roshni", "kiran"], "bn": ["jyoti", "alo", "prakash", "deep", "kiran"], "ta": ["velicham", "oli", "theepam", "kiran"], "te": ["velugu", "prakaasam", "deepam", "jyothi"], "mr": ["prakash", "ujed", "jyoti", "deep"], "gu": ["prakash", "ujash", "jyoti", "deepak"], "kn": ["belaku", "prakasha", "jyothi", "deepa"], "ml": ["velicham", "prakasham", "deepam"], "pa": ["roshni", "channan", "jyoti", "prakash"], "ur": ["roshni", "noor", "ujala", "kiran"], "or": ["aloka", "jyoti", "dipaka"]}),
    ("sun", "nature", {"en": ["sun", "solar"], "hi": ["surya", "ravi", "bhaskar", "dinkar", "aditya", "bhanu"], "bn": ["surya", "robi", "bhaskar", "aditya"], "ta": ["suriyan", "kathiravan", "aadirai", "dinamani"], "te": ["suryudu", "ravi", "bhanudu", "bhaskara"], "mr": ["surya", "ravi", "bhaskar"], "gu": ["surya", "ravi", "bhaskar"], "kn": ["surya", "ravi", "bhaskara"], "ml": ["suryan", "ravi", "bhanu"], "pa": ["suraj", "ravi"], "ur": ["suraj", "shams", "khursheed"], "or": ["surya", "rabi", "bhaskara"]}),
    ("moon", "nature", {"en": ["moon", "lunar"], "hi": ["chandra", "chand", "shashi", "soma", "indu", "himanshu"], "bn": ["chandra", "chand", "shoshi", "shashi"], "ta": ["chandran", "nilavu", "thingal"], "te": ["chandrudu", "chandamama", "sasi"], "mr": ["chandra", "chand"], "gu": ["chandra", "chand"], "kn": ["chandra", "tingalu"], "ml": ["chandran", "thingal"], "pa": ["chann", "chand"], "ur": ["chand", "qamar", "hilal"], "or": ["chandra", "jahn"]}),
    ("revolution", "society", {"en": ["revolution"], "hi": ["kranti", "inquilab"], "bn": ["kranti", "biplob"], "ta": ["puratchi"], "te": ["viplavam"], "mr": ["kranti"], "gu": ["kranti"], "kn": ["kranthi"], "ml": ["viplavam"], "pa": ["inquilab", "kranti"], "ur": ["inquilab"], "or": ["kranti", "biplaba"]}),
    ("victory", "society", {"en": ["victory", "triumph", "win"], "hi": ["vijay", "jeet", "jay", "fatah"], "bn": ["bijoy", "joy", "jeet"], "ta": ["vetri", "jayam"], "te": ["vijayam", "gelupu", "jayam"], "mr": ["vijay", "jit", "jay"], "gu": ["vijay", "jit", "jay"], "kn": ["vijaya", "gelluvu", "jaya"], "ml": ["vijayam", "jayam"], "pa": ["jeet", "vijay", "fateh"], "ur": ["fatah", "jeet", "kamrani"], "or": ["bijaya", "jaya"]}),
    ("peace", "society", {"en": ["peace", "harmony"], "hi": ["shanti", "aman", "sukoon", "chain"], "bn": ["shanti", "aman"], "ta": ["amaithi"], "te": ["shanthi"], "mr": ["shanti", "aman"], "gu": ["shanti", "aman"], "kn": ["shanthi"], "ml": ["samadhanam", "shanthi"], "pa": ["aman", "shanti"], "ur": ["aman", "sukoon", "salaam"], "or": ["shanti"]}),
    ("new", "modifier", {"en": ["new", "novel", "modern"], "hi": ["naya", "nayi", "nav", "nava", "navin", "adhunik"], "bn": ["notun", "nobo", "nava", "kotha"], "ta": ["puthiya", "pudhu", "nava"], "te": ["kottha", "nava", "nuthana"], "mr": ["naveen", "nava", "naya"], "gu": ["navu", "nava", "naya"], "kn": ["hosa", "nava", "nuthana"], "ml": ["puthiya", "nava"], "pa": ["nawan", "nava", "naya"], "ur": ["naya", "jadeed"], "or": ["nua", "naba", "nutana"]}),
]
