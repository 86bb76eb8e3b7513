"""Fixed values of published results that the operators must reproduce, stated as given there."""

CONDITIONS = ["ARTHRITIS", "COPD", "CURRENT_ASTHMA", "DEPRESSIVE_DISORDER", "DIABETES", "ISCHEMIC_HEART_DISEASE", "KIDNEY_DISEASE", "OTHER_CANCER", "SKIN_CANCER", "STROKE"]

#: Edge masks of 94 graphs: of each of 47 states the higher, then the lower one.
MASKS = [
    4710505517593, 4675072038525, 4432406250104, 4673998160273, 4435627475696, 4675071918681, 4676145846015, 4676145845823,
    6926708511705, 4673998160457, 4710505386713, 4675072033373, 4675071901905, 4399120257625, 4710505387553, 4435627475641,
    4709431644761, 4724464162393, 4727685255801, 4710506045053, 4675071902240, 4707284156969, 4847944471185, 4678293262353,
    4676145648377, 4675072037465, 4710505388665, 4710505517945, 4676145648217, 4708358034137, 4435627610841, 4744865256057,
    4710505386745, 4762045208575, 4676145644153, 4710505583161, 4710505386617, 5260261333883, 4676145644120, 4710505382649,
    4672924418297, 4673998291673, 4727685382873, 4710505519099, 4710505381977, 4676145648473, 4710505517661, 4676145648441,
    4672924418113, 4710505526041, 4710505386553, 4708358116089, 4675071905881, 4399120388625, 4399120253529, 4673998291657,
    4398046511120, 4399120253789, 4710505517689, 4710505518687, 4676145647769, 4673998292937, 4673998295609, 5294621090617,
    4710505382489, 4710505583231, 4693325518397, 4676145715065, 4401267872377, 4709431841625, 5277441196784, 865435914305,
    4710505386193, 4673998176797, 4710505386747, 6909528653567, 4672924418580, 5223753974017, 4710505382653, 4710505517599,
    4435627475705, 4675072033784, 4676145648217, 4693325648435, 4710505517817, 4708357904987, 4676145775345, 4675072037595,
    4710505517753, 4710505518651, 4710505517657, 4673998295897, 4673998295113, 4781372415197,
]

#: State codes of the graphs.
STATES = [
    1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 29,
    30, 31, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 44, 45, 46, 48, 49, 50, 51, 53, 54, 55, 56,
]

#: Sums over the graphs.
TOTALS = {"edge_count": 1057, "component_count": 207, "isolate_count": 83, "largest_component_nodes": 794, "triangle_count": 353, "ineligible_dyad_count": 39}

#: Motifs in at least so many graphs.
SPECTRUM = {8: 1365, 10: 1098, 19: 542, 29: 342}

#: Of the 1,098 motifs: closed, maximal, occurrence classes.
REDUNDANCY = (518, 114, 448)

#: Motifs by least support and number of nodes.
SIZES = {10: {3: 67, 4: 257, 5: 774}, 19: {3: 43, 4: 149, 5: 350}, 29: {3: 39, 4: 102, 5: 201}}

#: Lower minus higher density residual by state (codes, then one list a hypothesis).
DIFFERENCE_STATES = [
    1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 15, 16, 17, 18, 19, 20, 22, 23, 24, 25, 26, 27, 28, 29,
    30, 31, 33, 34, 35, 36, 37, 38, 39, 40, 41, 44, 45, 46, 47, 48, 49, 50, 51, 53, 54, 55, 56,
]
DIFFERENCES = {
    "H1": [
        0.9882546394174302, 0.00025148889717973156, -0.9980200677875096, 0.9974160206718347,
        -0.999264830461654, -0.0018280299798047656, 0.9991092036469235, -0.0002922016535175922,
        -1.0045035068290882, 0.9886304909560724, -3.380372070105479e-05, 0.9960896543426323,
        -0.00032485222203704455, 0.0, 0.9975234068257324, -1.0,
        -0.011745360582569885, -0.0043625625020973224, -0.0013691734621967822, -0.9972449558382627,
        -1.0, -0.004792107117688513, -0.0016692230098522848, 0.0008053961542333634,
        -0.003087351924561227, -0.9980871841336958, 0.9954360884593443, -0.000369139904023625,
        -0.00017598180405560874, -0.004765260579214068, 0.9940818934012355, -0.9987133305340905,
        0.0, 0.003389375482398738, -0.9972449558382627, 0.00033001598514928064,
        -1.0100003355817309, -6.711634618611362e-05, -0.011174871639987871, -0.004563911540655727,
        -0.006248531829927179, -0.9995187266883239, 0.9937514681700729, -0.0033960871170173323,
        0.9980804724990772, -1.0011074197120708, 0.0007116536328107513,
    ],
    "H2": [
        -0.09292929292929297, 0.003030303030303029, 0.03434343434343434, 0.9767676767676768,
        -0.9794926004228329, 0.9705905205905205, -0.020599725477774222, -0.004379341588643913,
        -1.0363636363636364, 0.9151515151515152, -0.005013591060102689, 0.9420618141548374,
        -1.0131885658201447, 0.0, -0.030303030303030276, -1.0,
        0.907070707070707, -0.027272727272727337, -0.019191919191919204, -0.9643410852713179,
        -1.0, -1.0727272727272728, -0.028860028860028857, -0.9898989898989898,
        -0.045454545454545456, -0.9787878787878788, -0.0575757575757575, -0.013131313131313133,
        -1.0093538472471442, -0.06868686868686869, 0.9376904937880547, -0.9824994127319708,
        0.0, -0.9666666666666667, -0.9643410852713179, 0.006765327695560253,
        -1.0656565656565657, -0.00505050505050505, -0.05858585858585863, 0.9424242424242425,
        -0.06363636363636363, -0.992600422832981, 0.9363636363636363, -0.025252525252525304,
        0.9868686868686868, -1.011111111111111, 0.018942033576179917,
    ],
    "H3": [
        0.9882546394174302, 0.00025148889717973156, 0.001979932212490352, -0.002583979328165375,
        0.0007351695383459422, 0.9981719700201953, -0.0008907963530765573, -0.0002922016535175922,
        0.9954964931709118, -0.01136950904392765, -3.380372070105479e-05, 0.9960896543426323,
        -0.00032485222203704455, 0.0, -0.0024765931742676273, 0.0,
        0.9882546394174302, -0.0043625625020973224, -0.001369173462196718, 1.0027550441617372,
        0.0, 0.9952078928823115, 0.9983307769901477, 0.0008053961542333634,
        -0.0030873519245612213, 0.0019128158663042384, 0.9954360884593443, 0.9996308600959763,
        -0.00017598180405560874, 0.9952347394207859, -0.0059181065987645685, 0.0012866694659093977,
        0.0, -0.9966106245176013, 0.0027550441617372984, 0.00033001598514928064,
        -0.010000335581730932, -6.711634618611362e-05, 0.9888251283600121, -0.004563911540655727,
        0.9937514681700729, 0.0004812733116760343, -1.006248531829927, 0.9966039128829827,
        -0.0019195275009228352, 0.9988925802879292, 0.0007116536328107513,
    ],
}

#: Hypothesis: direction, studentized statistic, one-sided p and Holm's p at 99,999 sign flips of seed 20230904.
TESTS = {"H1": (-1, -0.4469956092992292, 0.26384, 0.26384), "H2": (-1, -1.6606687604257258, 0.05308, 0.10616), "H3": (1, 3.492268396546545, 0.00105, 0.00315)}

#: Motif ids of two edge lists.
IDS = {
    "motif_a79cab0e1b2c2fbf": [("ARTHRITIS", "ISCHEMIC_HEART_DISEASE"), ("ARTHRITIS", "OTHER_CANCER"), ("DIABETES", "ISCHEMIC_HEART_DISEASE"), ("DIABETES", "KIDNEY_DISEASE")],
    "motif_eeb4d747c66beaa4": [("DIABETES", "ISCHEMIC_HEART_DISEASE"), ("DIABETES", "KIDNEY_DISEASE")],
}
