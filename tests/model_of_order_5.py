"""An order-5 model with oddities: positive and missing back-offs, n-grams of <unk>, missing suffixes. Entries by n-gram: log10 probability, back-off."""

FIVE = {
    "i would": (-0.2922095, None),
    "also would": (-2.0, -6.0),
    "would": (-1.687872, -0.30103),
    "<s> what": (-1.07153, None),
    "what": (-1.687872, -0.30103),
    "<s> watching": (-1.07153, None),
    "watching": (-1.687872, -0.30103),
    "consider watch": (-0.2922095, None),
    "watch": (-1.687872, -0.30103),
    "is to": (-0.2922095, None),
    "to": (-1.687872, -0.30103),
    "<s> the": (-1.07153, None),
    "the": (-1.687872, -0.30103),
    "higher small": (-0.5845945, None),
    "small": (-1.687872, -0.30103),
    "the screening": (-0.287799, None),
    "<s> screening": (-1.051485, None),
    "screening": (-1.509559, -0.4771212),
    "<s> looking on": (-0.3488368, -0.4771212),
    "looking on": (-0.4638903, -0.4771212),
    "on": (-1.509559, -0.4771212),
    "screening a little more": (-0.005464747, None),
    "looking on a little more": (-0.001813953, None),
    "on a little more": (-0.005464747, -0.4771212),
    "a little more": (-0.01660496, -0.09409451),
    "little more": (-0.09021038, -0.1998621),
    "higher more": (-0.5511513, None),
    "more": (-1.206319, -0.544068),
    "also would consider higher looking": (-5.0, None),
    "<s> looking": (-0.4846522, -0.4771214),
    "looking": (-1.285941, -0.4771212),
    "to look": (-0.2922095, None),
    "look": (-1.687872, -0.30103),
    "on a little more loin": (-0.0432557, None),
    "a little more loin": (-0.1453306, None),
    "little more loin": (-0.1892331, None),
    "more loin": (-0.3561665, None),
    "loin": (-1.383514, -0.30103),
    "screening a little": (-0.0283603, -0.4771212),
    "<s> looking on a little": (-0.003061223, None),
    "looking on a little": (-0.009249173, -0.4771212),
    "on a little": (-0.0283603, -0.4771212),
    "a little": (-0.09132547, -0.69897),
    "little": (-1.285941, -0.69897),
    ", is": (-0.7522095, None),
    "is": (-1.687872, -0.30103),
    "concerns in": (-0.2922095, None),
    "in": (-1.687872, -0.30103),
    "beyond immediate": (-0.2922095, None),
    "immediate": (-1.687872, -0.30103),
    "what i": (-0.2922095, None),
    "i": (-1.687872, -0.30103),
    "<unk> however": (-4.0, -1.0),
    ", however": (-0.7522095, None),
    "however": (-1.687872, -0.30103),
    "<s> looking higher": (-0.3488368, None),
    "looking higher": (-0.4638903, None),
    "also would consider higher": (-4.0, -8.0),
    "higher": (-1.509559, -0.30103),
    "call for": (-0.2922095, None),
    "for": (-1.687872, -0.30103),
    "foo": (-3.141592, None),
    "watching considering": (-0.2922095, None),
    "considering": (-1.687872, -0.30103),
    "also would consider": (-3.0, -7.0),
    "considering consider": (-0.2922095, None),
    "consider": (-1.687872, -0.30103),
    "immediate concerns": (-0.2922095, None),
    "concerns": (-1.687872, -0.30103),
    "also call": (-0.2922095, None),
    "call": (-1.687872, -0.30103),
    "in biarritz": (-0.2922095, None),
    "biarritz": (-1.687872, -0.30103),
    "look beyond": (-0.2922095, None),
    "beyond": (-1.687872, -0.30103),
    "baz": (-6.535897, -0.0),
    "foo bar": (-6.0, None),
    "bar": (-2.718281, 3.0),
    "would also": (-0.2922095, None),
    "also": (-1.687872, -0.30103),
    "screening a": (-0.1649931, -0.4771213),
    "<s> looking on a": (-0.01552657, -0.4771212),
    "looking on a": (-0.04835128, -0.4771212),
    "on a": (-0.1649931, -0.4771213),
    "to look a": (-7.0, None),
    "a": (-1.285941, -0.69897),
    "<unk> however <unk>": (-6.0, -12.0),
    "<unk> <unk>": (-15.0, -2.0),
    "<unk>": (-1.995635, -20.0),
    "<s>": (-99.0, -0.4149733),
    "watch </s>": (-0.2622373, None),
    "loin </s>": (-0.6708385, None),
    "more . </s>": (-0.01916512, None),
    ". </s>": (-0.0602359, None),
    "</s>": (-1.029493, None),
    "small .": (-0.2705918, None),
    "more .": (-0.5136299, -0.4771212),
    "loin .": (-0.6925742, None),
    "biarritz .": (-0.2705918, None),
    ", .": (-0.6925742, None),
    ".": (-1.139057, -0.845098),
    "loin ,": (-0.7273645, None),
    "however ,": (-0.2834328, None),
    "for ,": (-0.2834328, None),
    ",": (-1.383514, -0.30103),
}
