"""Given names of general knowledge in several languages, folded: common ones with their usual short forms, and common ones without.

Compiled from everyday usage, not from any table of entities; callers extend both.
"""

#: Given name -> its usual nicknames.
NICKNAMES = {
    "abigail": "abby gail", "adelheid": "heidi adele", "albert": "al bert bertie albi", "alejandro": "alex ale jandro", "aleksandra": "ola sasha", "alexander": "alex sandy xander sasha lex al",
    "alexandra": "alex sandra sasha lexi", "alfred": "alf fred freddie", "anastasia": "nastya stacy ana", "andrea": "andi drea", "andreas": "andi andy dres", "andrew": "andy drew", "anneke": "anne anni anke",
    "anthony": "tony ant", "antonio": "toni tonio", "arthur": "art artie", "barbara": "barb babs barbie", "beatrice": "bea trixie", "beatriz": "bea betty trix bia", "benjamin": "ben benji benny bennie",
    "bernhard": "bernd hardy bernie", "birgit": "gitte biggi", "carolina": "caro carol lina", "catherine": "cathy cate kate katie", "cecilia": "ceci cissy celia", "charles": "charlie chuck chas",
    "charlotte": "charlie lottie lotte char", "christina": "chris tina christy", "christopher": "chris kit topher", "claudia": "clau claudi", "concepcion": "concha conchita", "cordula": "cora cordi",
    "cynthia": "cindy", "daniel": "dan danny dani", "david": "dave davy", "deborah": "deb debbie", "desiree": "desi dee", "diego": "dieguito", "dimitri": "dima mitya dimi", "dolores": "lola loli dolly", "donald": "don donnie",
    "dorothy": "dot dottie dolly", "edmund": "ed ned eddie", "eduardo": "edu lalo", "edward": "ed eddie ted ned", "ekaterina": "katya katia", "eleanor": "ellie nell nora ella lena", "elizabeth": "liz beth lizzie betty eliza betsy libby lisa ellie",
    "emily": "em emmy millie", "enrique": "quique kike", "ernst": "erni", "esther": "essie hettie", "eugene": "gene", "fatou": "fatoumata fatu", "fernando": "fer nando", "florence": "flo florrie", "frances": "fran fanny frankie",
    "francisco": "paco pancho fran frank kiko", "franziska": "franzi ziska", "frederick": "fred freddie rick", "friedrich": "fritz friedel", "gabriel": "gabe gabi", "gerald": "gerry jerry", "gerhard": "gerd hardy",
    "giovanni": "gianni nino", "giuseppe": "beppe pino peppe", "gregory": "greg", "greta": "gretel gretchen", "guadalupe": "lupe lupita", "gustav": "gus gustl", "harold": "harry hal", "hedwig": "hedi hede wiggerl hedda",
    "heinrich": "heinz heiner", "henrietta": "hetty etta", "henrike": "rike henni henny", "henry": "harry hank hal", "ignacio": "nacho", "ines": "agnes", "ingrid": "inga inge", "isabel": "isa bel chabela", "isabella": "bella isa izzy",
    "jacob": "jake coby", "james": "jim jimmy jamie", "janet": "jan jenny", "jennifer": "jen jenny", "jessica": "jess jessie", "jesus": "chuy chus", "joachim": "jochen achim", "johannes": "hans hannes jo johann jan", "john": "jack johnny jon",
    "jonathan": "jon john jonny nathan johnny", "jose": "pepe chepe", "joseph": "joe joey jo", "josephine": "josie jo fina josefa sophie posy", "joshua": "josh", "judith": "judy jude", "jurgen": "jurg jorg", "kasimir": "kaz kazik kas",
    "katarzyna": "kasia kaska", "katherine": "kate kathy katie kat kit cathy", "kenneth": "ken kenny", "konrad": "kuno conny", "krzysztof": "krzys", "lawrence": "larry laurie", "leandro": "leo lean", "leonard": "leo len lenny", "louis": "lou louie",
    "lucinda": "lucy cindy lu", "ludovic": "ludo lou", "ludwig": "lutz wiggerl", "luigi": "gigi gino", "magdalena": "lena magda leni maggie", "malgorzata": "gosia", "manuel": "manolo manu", "margaret": "maggie meg peggy greta marge daisy madge",
    "maria": "mia mari masha", "martin": "marty", "mathilde": "tilda tilly mathi thilde", "matthew": "matt matty", "maximilian": "max", "mercedes": "merche", "michael": "mike mick mikey micha mitch", "mikhail": "misha", "mireille": "mimi mireia", "natalia": "natasha nati",
    "nathaniel": "nat nate", "nicholas": "nick nico klaus niklas nicky claus", "nikolai": "kolya niko", "octavio": "tavo tavi", "olivia": "liv livvy", "oscar": "ossi osci", "ottilie": "otti tilly tilli", "pamela": "pam", "patricia": "pat trish patty tricia patsy", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil pip", "philippa": "pippa pip phil", "priya": "pri", "quentin": "quin quent", "rafael": "rafa", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich richie ricky", "robert": "bob rob bobby robbie bert", "roberto": "beto", "ronald": "ron ronnie",
    "rosalind": "rosie ros linda roz rose", "rosario": "charo", "rufus": "rufe ru", "samuel": "sam sammy", "sandra": "sandy", "sebastian": "seb basti bastian seba", "sergei": "seryozha", "sieglinde": "linde siggi sigi linda", "soraya": "sora raya", "stephen": "steve stevie",
    "susan": "sue susie suzie", "susanne": "susi sanne", "tatiana": "tanya tati", "theodore": "ted theo teddy ned", "theresa": "terry tess tessa", "thomas": "tom tommy", "timothy": "tim timmy", "tomasz": "tomek tom tommy", "ulrich": "uli ulli", "umberto": "berto umbe", "victoria": "vicky tori vic vicki",
    "viktor": "vik vic vitya", "vincent": "vince vinny", "virginia": "ginny ginger", "vladimir": "vova volodya", "walter": "walt wally", "wendell": "wen dell", "wilhelm": "willi wim", "william": "will bill billy liam willy wim", "wolfgang": "wolf wolfi", "xenia": "xen ksenia xeni", "yusuf": "yus joe yousef", "zachary": "zach zack",
}
#: Given names without a usual short form.
PLAIN = frozenset(
    "adam ahmed aisha akira ali alice amara amelia amina amir ana anders anita anna arjun astrid bjorn boris brian bruno cagla carla carlos carmen chiara chloe clara daiki deepak denise elena elias elsa emeka emma erik eva fatima felix finn francois gloria grace hamza hannah haruto hassan "
    "helena hiroshi hugo ibrahim igor ivan jakob jana javier jing jorge juan julia kai karin karl keiko kemal kofi kwame laila lara laura leila leon lia liang linda ling lucas lucia luis luisa marco marek mario mark marta mary mateo mei mehmet mila ming minh miriam mohamed mona nadia naoko nina noah olga omar oliver pablo paolo paul paula "
    "paulo pedro petra pierre rania ravi ricardo rita rosa ruth ryan salma sara sarah simon sofia sophia stefan sven svetlana tariq thanh ursula vera victor viktoria vijay wei xiang yara yasmin yuki yuna yusra zainab zelda zeynep zoe".split()
)
