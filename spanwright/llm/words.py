"""Common English words, roughly by frequency (fixed values)."""

COMMON = (
    "the and that have for not with you this but his from they she her will one all would there their what out about who get which when make can "
    "like time just him know take people into year your good some could them see other than then now look only come its over think also back "
    "after use two how our work first well way even new want because any these give day most are was were been being has had did does done said "
    "made went gone much many more such here where why again once never always often still already yet too very really quite rather almost "
    "enough perhaps maybe may might must shall should cannot before during while until since between among through under above below against "
    "without within along across around behind beyond toward towards upon off down each every both either neither another few several same "
    "different own next last long short high low large small great little big old young early late right left wrong true false real sure "
    "simple easy hard difficult possible impossible important necessary available valid invalid expired missing required optional secure "
    "insecure unsafe safe secret hidden private public open closed empty full correct incorrect different unique random strong weak known unknown "
    "unchanged changed wrong broken lost stolen found stored saved deleted removed created generated encrypted decrypted hashed encoded decoded sent "
    "received shared used unused reused revoked rejected accepted denied granted allowed forbidden needed provided given taken kept "
    "written typed entered shown displayed printed logged cached checked verified tested validated signed issued renewed refreshed updated "
    "rotated reset disabled enabled active inactive blocked locked unlocked protected exposed leaked compromised visible invisible "
    "temporary permanent limited unlimited sensitive confidential personal common ordinary special general specific particular "
    "certain obvious clear simply clearly exactly nothing something anything everything someone anyone everyone nobody somebody "
    "nowhere somewhere anywhere everywhere never whatever whoever whenever wherever however although though unless whether therefore "
    "because instead indeed actually usually generally probably certainly finally currently recently immediately automatically "
    "manually directly properly correctly incorrectly securely safely carefully quickly slowly together alone away today tomorrow yesterday "
    "number numbers letter letters character characters digit digits symbol symbols string strings value values word words sentence text "
    "name names user users account accounts email address phone message messages file files folder document documents page pages "
    "website internet network server client computer machine device system systems software hardware program application service "
    "services request response error errors warning problem problems question questions answer answers reason reasons result results "
    "example examples information data database table record records field fields list lists code codes key keys password passwords "
    "passphrase passcode token tokens secrets credential credentials session login logout register registration authentication "
    "authorization permission permissions access security policy policies rule rules option options setting settings configuration "
    "default defaults version change changes update updates release issue issues support help contact company business market money "
    "price cost value trade bank government country state city town world school university student teacher family friend friends "
    "mother father parents child children baby brother sister husband wife man men woman women girl boy person human life live living love "
    "death dead body head hand hands face eyes eye heart mind voice story book books music movie picture game games sport team player "
    "house home room door window street road car train water fire air earth land sea river mountain tree flower animal dog cat bird "
    "horse fish food bread meat fruit coffee morning evening night week month hour minute second moment season spring summer autumn "
    "winter january february march april june july august september october november december monday tuesday wednesday thursday "
    "friday saturday sunday red blue green yellow black white brown orange purple pink grey gray silver golden color light dark bright "
    "hot cold warm cool dry wet clean dirty fast slow near far deep wide narrow heavy soft loud quiet quick happy sad angry "
    "afraid proud sorry tired hungry sick healthy rich poor free busy ready alive beautiful pretty ugly nice fine kind cruel brave clever smart "
    "stupid strange funny serious careful famous popular modern ancient natural normal perfect terrible wonderful excellent amazing "
    "interesting boring useful useless helpful dangerous complete incomplete final main major minor single double multiple whole half "
    "third fourth fifth hundred thousand million billion three four five six seven eight nine ten eleven twelve twenty zero none null "
    "begin start stop end finish continue become remain stay leave arrive return enter exit follow lead move turn run walk drive fly "
    "sit stand sleep wake eat drink cook wash wear buy sell pay spend save win lose play sing dance read write speak talk tell say ask "
    "call hear listen watch learn teach study understand remember forget believe hope wish need try keep hold carry bring send receive "
    "put set let show hide find search discover create build break repair cut draw paint grow plant kill fight attack defend protect "
    "guard allow permit prevent avoid refuse reject accept agree disagree decide choose offer suggest recommend explain describe discuss "
    "mention report announce publish share join connect separate divide combine include exclude contain consist belong depend "
    "require expect suppose imagine consider compare measure count check test prove happen occur appear disappear seem sound feel touch "
    "smell taste history science nature power energy force speed distance weight size shape form type kind sort part piece side "
    "place area region point line level order group class case fact idea thought plan project process method practice theory "
    "model study research development education experience knowledge skill ability effort success failure chance opportunity "
    "choice decision action activity event situation condition position relationship difference effect cause purpose interest attention "
    "power control responsibility duty law court police army war peace freedom justice truth lie trust doubt fear danger risk safety "
    "happiness trouble pleasure pain health disease medicine doctor nurse hospital patient patience courage discipline consistency "
    "preparation persistence kindness honesty practicing listening learning working keeping making using having getting going "
    "looking knowing trying waiting running missing coming leaving nobody ours yours mine theirs himself herself itself myself yourself "
    "themselves ourselves regular irregular similar equal unequal longer shorter larger smaller better worse best worst less least"
).split()
